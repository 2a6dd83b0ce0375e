"""Nested shapes shared by sources and operators."""

from __future__ import annotations

FIELD = "STRUCT<value: STRING, verbatim: STRING, page: INT>"

# The attributes of one extracted letter, in order of storage.
SCALAR_KEYS = ["letter_ref", "dated", "received", "from_party", "to_party", "subject"]
LIST_KEYS = {"chainage": "chainage", "clause": "clause", "cited_refs": "cited_ref"}

EXTRACTION = (
    "STRUCT<letters: ARRAY<STRUCT<page_from: INT, page_to: INT, "
    + ", ".join(f"{k}: {FIELD}" for k in SCALAR_KEYS)
    + ", "
    + ", ".join(f"{k}: ARRAY<{FIELD}>" for k in LIST_KEYS)
    + ">>>"
)

BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
TOKENS = (
    f"ARRAY<STRUCT<text: STRING, char_start: INT, char_end: INT, bbox: {BOX}, confidence: DOUBLE>>"
)

# The states a row may be in.
VALIDATION = ["exact", "normalized_exact", "unresolved", "human_corrected"]
FIELD_REVIEW = ["unreviewed", "verified", "corrected", "rejected"]
REVIEW_STATUS = ["verified", "unverified", "needs_review"]
DIRECTION = ["inward", "outward"]
RESOLUTION = ["resolved", "unresolved_missing", "unresolved_ambiguous"]
SOURCE = ["pipeline", "human", "alias"]
RUN_STATUS = ["running", "succeeded", "failed", "superseded"]

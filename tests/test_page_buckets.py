"""Page texts move once, before they become words; joins on the page move the other side only."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from missive.operators import audit, provenance
from missive.plans import bridge, linked

SF_DIR = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_words_are_not_shuffled(spark):
    plan = linked.assembled_pages(spark, SF_DIR, 8)._jdf.queryExecution().executedPlan().toString()
    words = [i for i, line in enumerate(plan.splitlines()) if "word_no" in line and "Generate" in line]
    moved = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line and "REPARTITION_BY_NUM" in line]
    assert len(moved) == 1 and words and max(words) < moved[0], plan
    assert not [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line and i < max(words)], plan


def test_joins_on_the_page_move_the_claims_only(spark):
    assembled = linked.page_ocr(spark, SF_DIR)
    claims = bridge.page_claims(assembled).selectExpr("document_id", "if(document_id % 9 = 0, 999999, page) AS page", "claim_no", "verbatim")
    assert len(exchanges(provenance.build_fields(claims.hint("merge"), assembled))) == 1
    located = provenance.locate_verbatim(claims.hint("merge"), assembled)
    assert len(exchanges(provenance.map_spans(located.hint("merge"), assembled))) == 1


def test_audit_looks_anywhere_in_a_page(spark):
    text = "aé" * 500 + " " + "x" * 300
    spans = [(0, 2), (999, 1001), (1001, 1301), (1300, 1301), (1301, 1305), (5000, 5002), (-3, 1), (4, 4), (7, 3)]
    rows = [(n, a, b) for n, (a, b) in enumerate(spans)]
    plain = spark.createDataFrame(rows, "n int, a int, b int").selectExpr("n", f"substring('{text}', a + 1, b - a) AS part").collect()
    parts = {r.n: r.part for r in plain}
    for wrong in (False, True):
        tokens = [(parts[n] + ("!" if wrong else ""), a, b) for n, a, b in rows]
        page = spark.createDataFrame(
            [(1, 1, text, tokens), (2, 1, None, tokens)],
            "document_id int, page_no int, text string, tokens array<struct<text:string,char_start:int,char_end:int>>",
        )
        found = {(r.document_id, r.token_no): r.actual for r in provenance.audit_tokens(page).collect()}
        assert found == ({(1, n): parts[n] for n in parts} if wrong else {})


def test_fields_are_placed_once_for_all_rules(spark):
    pages = spark.createDataFrame(
        [(1, 1, "ab cd", [("ab", 0, 2, (0.0, 0.0, 1.0, 1.0), 1.0), ("cd", 3, 5, (2.0, 0.0, 1.0, 1.0), 1.0)])],
        "document_id long, page_no int, text string, tokens array<struct<text:string,char_start:int,char_end:int,"
        "bbox:struct<x:double,y:double,width:double,height:double>,confidence:double>>",
    )
    claims = spark.createDataFrame(
        [(1, 1, 0, "ab"), (1, 1, 1, "cd"), (1, 1, 2, "no"), (1, 9, 3, "ab"), (1, 1, 4, None)], "document_id long, page int, claim_no int, verbatim string"
    )
    faulty = provenance.build_fields(claims, pages).selectExpr(
        "claim_no", "validation", "page_no", "if(claim_no = 0, NULL, bbox) AS bbox", "if(claim_no = 3, 7, char_start) AS char_start",
        "if(claim_no < 2, char_start, char_end) AS char_end",
    )
    found = audit.audit_geometry(faulty, F.col("claim_no"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    # nothing places a field in a condition as well
    assert not [x for x in plan.splitlines() if "Filter" in x and ("_text" in x or "verbatim" in x)], plan
    assert sorted((r.key, r.rule, r.table_name) for r in found.collect()) == [
        ("0", "end behind start", "fields"),
        ("0", "located fields have box, offsets and page", "fields"),
        ("1", "end behind start", "fields"),
        ("3", "unresolved fields have no box or offset", "fields"),
    ]

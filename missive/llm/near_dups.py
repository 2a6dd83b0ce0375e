"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most four have a half of 32 bits in which they differ in at most two, so their
balls of radius one around that half, half the radius, share a point. Every fingerprint emits the 33 points of the ball of
each half, the points are shuffled, and fingerprints that collide are verified on all bits. Points with many fingerprints
are not compared pair by pair: there each fingerprint also emits a ball around its other half, so that both flips together
stay within two bits, and whoever meets at such a double point is within four bits of all others there: a star of links
replaces the pairs. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, cut_lineage, partitions, texts
from missive.operators.threads import connected_components
from missive.session import grown

WORDS = 4
RADIUS = 4
# more fingerprints at one point than this are linked through double points instead of pair by pair
CROWD = 256
HALF = (1 << 32) - 1


def simhash(text: str, words: int = WORDS) -> int:
    """Unsigned fingerprint of one text: majority of the bits of its word shingles' XXH64, repeats included."""
    parts = text.encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not parts:
        return 0
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths).tolist()
    hashed, seed = xxhash.xxh64_intdigest, 42
    if len(parts) <= words:
        hashes = np.array([hashed(line, seed)], dtype="<u8")
    else:
        hashes = np.array([hashed(line[b:e], seed) for b, e in zip(begins, ends[words - 1 :].tolist())], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lot = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(lot, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint's bits as a long) of every whole text; missing texts count as empty and give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "print"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, print long")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _masks(flips: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(32), n)]


def _half(bits: Column, side: Column) -> Column:
    return F.when(side == 0, bits.bitwiseAND(_long(HALF))).otherwise(F.shiftrightunsigned(bits, 32))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (src, dst) of different fingerprints that connect all that differ in at most four bits.

    `prints` has a column `print`. Every pair within the radius is connected by a path of pairs within it, and no pair is
    beyond it.
    """
    near = _masks(1)
    # each row becomes 66: few bytes here are much work, so they are spread before they grow
    distinct = prints.where("print IS NOT NULL").select("print").distinct().repartition(partitions(prints.sparkSession))
    ball = F.array(*[_long(m) for m in near])
    points = distinct.select(
        "print",
        F.explode(
            F.concat(
                F.transform(ball, lambda m: _half(F.col("print"), F.lit(0)).bitwiseXOR(m)),
                F.transform(ball, lambda m: _half(F.col("print"), F.lit(1)).bitwiseXOR(m).bitwiseOR(_long(1 << 32))),
            )
        ).alias("point"),
    )
    # most points have one fingerprint; they end here, before anything is gathered
    shared = points.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark does not count what an explode adds: to it the 66 rows of a fingerprint have the size of one
    met = grown(points).join(shared, "point")

    side = F.shiftright("point", 32)
    place = F.col("point").bitwiseAND(_long(HALF))

    def here_only(a: Column, b: Column) -> Column:
        """The pair is within the radius, and of the points where it meets this is the one that counts."""
        both = a.bitwiseXOR(b)
        part = _half(both, side)
        between = F.when(F.bit_count(part) == 2, part.bitwiseAND(-part)).otherwise(_long(0))
        return (
            (F.bit_count(both) <= RADIUS)
            & (_half(a, side).bitwiseXOR(place) == between)
            & ((side == 0) | (F.bit_count(_half(both, F.lit(0))) > 2))
        )

    few = (
        met.where(F.col("n") <= crowd)
        .groupBy("point")
        .agg(F.sort_array(F.collect_list("print")).alias("here"))  # at most `crowd`
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "here",
                        lambda a: F.transform(
                            F.filter("here", lambda b: (a < b) & here_only(a, b)), lambda b: F.struct(a.alias("src"), b.alias("dst"))
                        ),
                    )
                )
            ).alias("link")
        )
        .select("link.src", "link.dst")
    )

    own = F.bit_count(_half(F.col("print"), side).bitwiseXOR(place))
    wide = F.array(*[_long(m) for m in _masks(2)])
    crowds = (
        met.where(F.col("n") > crowd)
        .select(
            "print",
            "point",
            F.explode(
                F.transform(
                    F.slice(wide, F.lit(1), F.when(own == 0, 529).otherwise(33)),
                    lambda m: _half(F.col("print"), 1 - side).bitwiseXOR(m),
                )
            ).alias("other"),
        )
        .groupBy("point", "other")
        .agg(F.collect_set("print").alias("here"))  # at most the 2,081 of one ball
        .where(F.size("here") > 1)
        .select(F.array_min("here").alias("src"), F.explode("here").alias("dst"))
        .where("src < dst")
    )
    return few.unionByName(crowds).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reached over links, its own included.

    Texts without words have fingerprint zero and are linked like any other; missing texts count as empty. Repeated rows
    give repeated result rows; a row without identifier takes part with its text and keeps a missing doc_id, and a component
    without any identifier has a missing component_id. Other columns are left out; no rows give no rows.
    """
    prints = cut_lineage(fingerprints(docs, words, id_col, text_col))
    classes = grown(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    joined = connected_components(classes.select(F.col("print").alias("id")), links(classes))
    found = grown(classes.join(joined.withColumnRenamed("id", "print"), "print"))
    lowest = found.groupBy("component").agg(F.min("first").alias("component_id"))
    named = found.join(lowest, "component").select("print", "component_id")
    return prints.join(grown(named), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, without near-duplicates: of each component the document with the smallest id.

    Of rows with one identifier one stays. Rows without identifier cannot stand for others and all stay.
    """
    found = near_duplicates(docs, words, id_col, text_col)
    stay = found.where("component_id IS NOT NULL").select(F.col("component_id").alias(id_col)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(grown(stay), id_col, "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.where(F.col(id_col).isNull()))

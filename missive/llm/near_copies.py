"""Near copies by exact similarity of word shingles: prefixes in a common order, exact verification, components.

A shingle is five words in a row as in `contamination`; the k-th occurrence of a shingle in a text is an element of its own, so
the similarity of two sets of elements is the sum of the lesser over the sum of the greater shingle counts. If all elements are
in one order, two sets with similarity `least` or more share an element among the first n - ceil(least * n) + 1 of each, n its
size. So every set emits these, and sets that meet are compared exactly; no pair is missed. Counts of elements by bucket, a byte for two elements, rule out most other pairs before
whole sets move. The order has elements that are
common in a sample last, which only keeps the meetings few. At an element where more than CROWD sets meet, all are compared
with one of them first, and then, in rounds, those that are still in different components with some of them, until all that are
left at an element are in one component or have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from missive.llm.common import bounded, cut_lineage, texts
from missive.llm.contamination import SHINGLE, _shingle_hashes, _word_hashes, words_of
from missive.operators.threads import connected_components

# least similarity, as numerator and denominator: whole numbers leave no rounding at the edge
LEAST = (4, 5)
CROWD = 64
# sets of such an element that all others there are compared with in the first round, and how many times more in the next
PIVOTS, MORE_PIVOTS = 16, 4
# texts, and elements found in several of them, that decide the order; any order gives the same result
SAMPLE_ROWS = 10_000
COMMON = 200_000
# bits of the filter that passes over texts without candidates; where it is full all texts pass
FILTER_BITS = 1 << 26


def elements(text: str, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text, the k-th occurrence of each apart, ascending; a text of fewer words is one shingle."""
    parts = words_of(text)
    if not parts:
        return np.zeros(0, dtype=np.int64)
    found = np.sort(_shingle_hashes(_word_hashes(parts), min(words, len(parts))))
    places = np.arange(len(found))
    begins = np.concatenate([[True], found[1:] != found[:-1]])
    nth = (places - np.maximum.accumulate(np.where(begins, places, 0))).astype(np.uint64)
    mixed = found ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.sort(np.where(nth > 0, mixed * np.uint64(0x9E3779B97F4A7C15), found).view(np.int64))


def set_print(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), len(found)) - (1 << 63)


def _counts(found: np.ndarray) -> bytes:
    """How many elements fall into each of about half as many buckets; nothing if a bucket has more than a byte can tell."""
    buckets = 1 << max(4, (len(found) // 2).bit_length())
    counts = np.bincount(found & (buckets - 1), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 255 else b""


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            sets = [elements(t, words) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array(map(set_print, sets), pa.int64()),
                pa.array(map(len, sets), pa.int64()),
                pa.array(map(_counts, sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "node", "n", "counts"])

    return run


def _sets(words: int, wanted: np.ndarray | None = None):
    """node, found: the elements of each different text of a task, of those only that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches, 1):
            nodes, lists = [], []
            for text in batch.column(1).to_pylist():
                found = elements(text, words)
                node = set_print(found)
                bit = node & (FILTER_BITS - 1)
                if node in seen or (wanted is not None and not int(wanted[bit >> 6]) >> (bit & 63) & 1):
                    continue
                seen.add(node)
                nodes.append(node)
                lists.append(found)
            if nodes:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), arrays], ["node", "found"])

    return run


def _prefixes(words: int, common: np.ndarray, uses: np.ndarray, least: tuple[int, int]):
    """key, node, n, place: the first elements of each different text of a task, in the order of use and hash."""
    sets = _sets(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for node, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = found.values.to_numpy()
                n = len(own)
                at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
                rank = np.where(common[at] == own, uses[at], 0) if len(common) else np.zeros(n, dtype=np.int64)
                first = n + least[0] * n // -least[1] + 1
                key = own[np.lexsort((own, rank))][:first]
                for column, values in zip(columns, (key, np.full(len(key), node), np.full(len(key), n), np.arange(len(key)))):
                    column.append(values)
            kinds = (np.int64, np.int64, np.int32, np.int32)
            arrays = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "n", "place"])

    return run


def _can_reach(a: Column, b: Column, least: tuple[int, int]) -> Column:
    """At the first common element of two sets: what is left is enough. (At later ones the pair has been met already.)"""
    most = F.least(a["n"] - a["place"], b["n"] - b["place"])
    return most.cast("long") * sum(least) >= (a["n"] + b["n"]).cast("long") * least[0]


def most_shared(a: bytes, b: bytes) -> int:
    """Elements that two sets have in common at most, by their counts."""
    if not a or not b:
        return 1 << 62
    less, more = sorted((np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)), key=len)
    return int(np.minimum(less, more.reshape(-1, len(less)).sum(axis=0)).sum())


def _filter_of(ends: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size that lets pass at least the nodes given."""
    bit = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    lines = (
        ends.groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((node & {FILTER_BITS - 1}) & 63 as int))")).alias("bits"))
        .toPandas()
    )
    wanted = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    wanted[lines["word"].to_numpy(dtype=np.int64)] = lines["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return wanted


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("node"))


def _plausible(pairs: DataFrame, sketches: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose bucket counts leave the least similarity possible: all similar ones, and few others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 3):
            columns = [c.to_pylist() for c in batch.columns]
            may = [most_shared(a, b) * sum(least) >= (n + m) * least[0] for _, _, n, a, m, b in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(may, pa.bool_())) for i in (0, 1)], ["src", "dst"])

    both = pairs.join(sketches.toDF("src", "n", "a"), "src").join(sketches.toDF("dst", "m", "b"), "dst")
    return both.select("src", "dst", "n", "a", "m", "b").mapInArrow(compare, "src long, dst long")


def _sets_of(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, found: the elements of the sets given, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter_of(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sets(words, shared.value)(batches)

    found = rows.mapInArrow(run, "node long, found array<long>")
    return cut_lineage(found.join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"]))


def _verified(
    rows: DataFrame, sketches: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int], sets: DataFrame | None = None
) -> DataFrame:
    """Those of the pairs (src, dst) whose sets reach the least similarity; whole sets move for plausible pairs only.

    `sets` has the elements of all sets of the pairs where they are known already.
    """
    pairs = cut_lineage(_plausible(cut_lineage(pairs.distinct()), sketches, least))
    if sets is None:
        sets = _sets_of(rows, _ends(pairs), words)
    both = F.size(F.array_intersect("a", "b")).cast("long")
    return (
        pairs.join(sets.select(F.col("node").alias("src"), F.col("found").alias("a")), "src")
        .join(sets.select(F.col("node").alias("dst"), F.col("found").alias("b")), "dst")
        .where(both * sum(least) >= (F.size("a") + F.size("b")).cast("long") * least[0])
        .select("src", "dst")
    )


def _links_in_crowds(
    rows: DataFrame, sketches: DataFrame, crowds: DataFrame, found: DataFrame, words: int, least: tuple[int, int]
) -> DataFrame:
    """The links `found` and those still needed to connect all similar sets that meet at crowded elements.

    Per element and round some sets are pivots: all sets there of other components are compared with them, so that they are
    done. A round is written before the next, whose components are fewer.
    """
    nodes = crowds.select(F.col("node").alias("id")).distinct()
    left, pivots, sets = crowds.where("node <> pivot").select("key", "node", "n", "place"), PIVOTS, None
    while True:
        joined = connected_components(nodes, found).withColumnRenamed("id", "node")
        named = left.join(joined, "node")
        split = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        named = cut_lineage(named.join(split, "key", "left_semi").select("key", F.struct("node", "n", "place", "component").alias("a")))
        if named.isEmpty():
            return found
        if sets is None:
            sets = _sets_of(rows, named.select("a.node"), words)
        a, b = F.col("a"), F.col("b")
        chosen = cut_lineage(
            named.groupBy("key", F.pmod(F.xxhash64("a.node"), F.lit(pivots)).alias("slot")).agg(F.min("a").alias("b")).drop("slot")
        )
        across = (
            named.join(chosen, "key")
            .where((a["component"] != b["component"]) & _can_reach(a, b, least))
            .select(F.least(a["node"], b["node"]).alias("src"), F.greatest(a["node"], b["node"]).alias("dst"))
        )
        found = cut_lineage(found.unionByName(_verified(rows, sketches, across, words, least, sets)))
        done = chosen.select("key", F.col("b.node").alias("node"))
        left = named.select("key", "a.node", "a.n", "a.place").join(done, ["key", "node"], "left_anti")
        pivots *= MORE_PIVOTS


def links(
    rows: DataFrame, sketches: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST, crowd: int = CROWD
) -> DataFrame:
    """Pairs (src, dst) of set prints that connect all sets of `rows(doc_id, text)` with the least similarity, and no others.

    `sketches` has the print, size and bucket counts of each set once.
    """
    spark = rows.sparkSession
    part = min(1.0, SAMPLE_ROWS / max(rows.count(), 1))
    often = (
        rows.sample(part, seed=1)
        .mapInArrow(_sets(words), "node long, found array<long>")
        .select(F.explode("found").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where("uses > 2")
        .orderBy(F.desc("uses"), "key")
        .limit(COMMON)
        .toPandas()
        .sort_values("key")
    )
    order = spark.sparkContext.broadcast((often["key"].to_numpy(dtype=np.int64), often["uses"].to_numpy(dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(words, *order.value, least)(batches)

    # one shuffle: where a key's sets meet, repeated ones go and the rest is counted; most keys have one set and end here
    points = rows.mapInArrow(run, "key long, node long, n int, place int").repartition("key").dropDuplicates(["key", "node"])
    at_key = Window.partitionBy("key")
    counted = points.withColumns({"here": F.count(F.lit(1)).over(at_key), "pivot": F.min("node").over(at_key)})
    met = cut_lineage(counted.where("here > 1"))
    few = (
        met.where(F.col("here") <= crowd)
        .groupBy("key")
        .agg(F.collect_list(F.struct("node", "n", "place")).alias("sets"))  # at most `crowd`
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "sets",
                        lambda a: F.transform(
                            F.filter("sets", lambda b: (a["node"] < b["node"]) & _can_reach(a, b, least)),
                            lambda b: F.struct(a["node"].alias("src"), b["node"].alias("dst")),
                        ),
                    )
                )
            ).alias("link")
        )
        .select("link.src", "link.dst")
    )
    crowds = met.where(F.col("here") > crowd)
    first = _verified(
        rows, sketches, few.unionByName(crowds.where("node <> pivot").select(F.col("pivot").alias("src"), F.col("node").alias("dst"))), words, least
    )
    first = cut_lineage(first)
    if crowds.isEmpty():
        return first
    return _links_in_crowds(rows, sketches, crowds, first, words, least)


def near_copies(
    docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reached over pairs of texts with the least similarity, its own included.

    Texts without words are like each other; missing texts count as empty. Repeated rows give repeated result rows; a row
    without identifier takes part with its text, and a component without any identifier has a missing component_id.
    """
    rows = texts(docs, id_col, text_col)
    prints = cut_lineage(rows.mapInArrow(_prints(words), "doc_id long, node long, n long, counts binary"))
    sketches = cut_lineage(prints.select("node", "n", "counts").dropDuplicates(["node"]))
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = connected_components(classes.select(F.col("node").alias("id")), links(rows, sketches, words, least))
    found = classes.join(joined.withColumnRenamed("id", "node"), "node")
    lowest = found.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "node").join(found.join(lowest, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def representatives(
    docs: DataFrame, words: int = SHINGLE, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs`, all their columns: of each component of near copies the document with the smallest id.

    Of rows with one identifier one stays. Rows without identifier cannot stand for others and all stay.
    """
    found = near_copies(docs, words, least, id_col, text_col)
    stay = found.where("component_id IS NOT NULL").select(F.col("component_id").alias(id_col)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.where(F.col(id_col).isNull()))

"""What several operators of this subpackage need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.session import checkpoint_root, cut_lineage

__all__ = [
    "bounded",
    "cut_lineage",
    "evenly_dealt",
    "id_bounds",
    "joined_to_classes",
    "partitions",
    "range_bucket",
    "range_numbers",
    "shared_folder",
    "table",
    "texts",
]

# keys with more than one in so many rows are joined by broadcast; there are fewer of them than this
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and whole text; a missing text counts as empty, other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(docs: DataFrame, parts: int) -> list[float]:
    """At most `parts` - 1 increasing identifiers that cut the rows into ranges of about equal counts."""
    cuts = [i / parts for i in range(1, parts)]
    if not cuts:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", cuts, 1 / (4 * parts))
    return sorted(set(found or []))


def range_bucket(id_col: str, bounds: list[float]) -> Column:
    """Number of the range an identifier falls into, ascending; missing identifiers come before all others."""
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(ids.to_numpy(dtype=np.float64, na_value=np.nan), bounds))

    return bucket(F.col(id_col))


def range_numbers(ids: np.ndarray, bounds: list[float]) -> np.ndarray:
    """The same for an array of identifiers, in which a missing one is not a number."""
    found = np.searchsorted(np.array(bounds, dtype=np.float64), ids, side="left") + 1
    return np.where(np.isnan(ids), 0, found).astype(np.int32)


def evenly_dealt(df: DataFrame, bucket: str, parts: int) -> DataFrame:
    """The rows in `parts` partitions, one for each range of `range_bucket` (the first also has missing identifiers).

    Hashing the numbers themselves would put several ranges into one partition and none into others, so each is replaced by a
    number that hashes to a partition of its own.
    """
    spark = df.sparkSession
    numbers = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("place")).agg(F.min("id").alias("id"))
    found = {r.place: r.id for r in numbers.collect()}
    keys = [found.get(k, k) for k in range(parts)]
    key = F.element_at(F.array(*[F.lit(k).cast("long") for k in keys]), F.greatest(F.col(bucket), F.lit(1)))
    return df.repartition(parts, key)


def joined_to_classes(rows: DataFrame, classes: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Rows with the columns of the one row that `classes` has for their key; without one they go, or stay with nulls (`keep`).

    The classes of keys that hold more than a thousandth of the rows, fewer than a thousand by that, are broadcast; the rest is
    shuffled, where no key has more rows than that.
    """
    total = rows.count()
    heavy = rows.groupBy(key).count().where(F.col("count") * HEAVY > total).select(key)
    few = classes.join(heavy, key, "left_semi").withColumn("is_heavy", F.lit(True))
    marked = rows.join(F.broadcast(few), key, "left")
    added = [c for c in classes.columns if c != key]
    light = marked.where("is_heavy IS NULL").select(rows.columns).join(classes, key, "left" if keep else "inner")
    names = [*rows.columns, *added]
    return marked.where("is_heavy").select(names).unionByName(light.select(names))


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about `most` bytes or list entries in one column, or a single row that has more."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pc.list_value_length(sizes) if pa.types.is_list(sizes.type) else pc.binary_length(sizes)
        lot = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False)) // most
        cuts = np.flatnonzero(np.diff(lot)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lot)]):
            if end > begin:
                yield batch.slice(begin, end - begin)

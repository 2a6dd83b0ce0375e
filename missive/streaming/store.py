"""Tables of a register in buckets of packages, changed batch by batch, each batch published at once.

A batch writes new folders (segments) of the tables it changes, split by bucket, and at the end one manifest file that names the
segments of every bucket. Readers take the newest manifest and see all of a batch or nothing of it; a batch that was cut short
leaves folders no manifest names, and one that is published already is not done again. Segments are never changed. Appended
tables keep one segment a batch and bucket until `FAN` of one level are merged into one of the next, so a bucket has few files
and rows are rewritten a logarithmic number of times. Replaced tables keep one segment a bucket.

A batch reads the buckets of the packages it touches and no others. One writer works at a time: two that publish the same
version conflict, and the second fails.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import cut_lineage

BUCKETS = 64
# segments of one level and bucket that are merged into one
FAN = 8
# names of published batches that are kept, so that a replay is known; a stream replays its last batch only
KEPT_BATCHES = 10_000

# one row for each table and bucket that has segments; `batch` names what published the version
MANIFEST = "name STRING, bucket INT, segments ARRAY<STRING>, batch STRING, batches ARRAY<STRING>, buckets INT"


class Table(NamedTuple):
    schema: str
    replaced: bool = False

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


def bucket_of(package: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(package.cast("long")), F.lit(buckets)).cast("int")


class Store:
    """The newest published version of the tables below a folder."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        # the versions are listed, and only the newest one's file is read
        try:
            files = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").inputFiles()
        except AnalysisException:
            files = []
        self.version = max((int(f.rsplit("/version=", 1)[1].split("/", 1)[0]) for f in files), default=-1)
        # tables x buckets rows of a few names each, whatever the tables hold
        newest = f"{self.path}/manifest/version={self.version}"
        rows = spark.read.schema(MANIFEST).parquet(newest).collect() if files else []
        self.buckets = rows[0]["buckets"] if rows else BUCKETS
        self.published: list[str] = rows[0]["batches"] if rows else []
        self.state = {(r["name"], r["bucket"]): tuple(r["segments"]) for r in rows if r["bucket"] is not None}

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = BUCKETS) -> Store:
        """An empty store; one that is there already stays as it is."""
        store = cls(spark, path, tables)
        if store.version < 0:
            store.buckets = buckets
            store.publish("create")
        return store

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table, of all buckets or some."""
        places = [
            f"{self.path}/{name}/segment={segment}/bucket={bucket}"
            for (table, bucket), segments in sorted(self.state.items())
            if table == name and (buckets is None or bucket in buckets)
            for segment in segments
        ]
        schema = self.tables[name].schema
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def write(self, name: str, rows: DataFrame, level: int = 0) -> dict[int, str]:
        """A new segment; the buckets that have rows in it."""
        segment = f"{level}-{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}/segment={segment}"
        rows = rows.select(*self.tables[name].columns).withColumn("bucket", bucket_of(F.col("package_id"), self.buckets))
        rows.write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{self.tables[name].schema}, bucket INT").parquet(folder).inputFiles()
        return {int(f.rsplit("/bucket=", 1)[1].split("/", 1)[0]): segment for f in written}

    def publish(self, batch: str) -> None:
        """Makes the state the newest version: one file, so it is there whole or not at all."""
        batches = [*self.published, batch][-KEPT_BATCHES:]
        rows = [(name, bucket, list(segments), batch, batches, self.buckets) for (name, bucket), segments in self.state.items()]
        rows = rows or [(None, None, [], batch, batches, self.buckets)]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("error").parquet(f"{self.path}/manifest/version={self.version + 1}")
        self.version, self.published = self.version + 1, batches


class Change:
    """A batch in the making over the packages it touches: what is read shows what it has written so far."""

    def __init__(self, store: Store, batch: str, packages: DataFrame) -> None:
        self.store, self.batch = store, batch
        self.packages = cut_lineage(packages.select(F.col("package_id").cast("long")).distinct())
        found = self.packages.select(bucket_of(F.col("package_id"), store.buckets).alias("bucket")).distinct().collect()
        self.buckets = sorted(r.bucket for r in found)

    def read(self, name: str) -> DataFrame:
        """Rows of the touched packages."""
        return self.store.read(name, self.buckets).join(self.packages, "package_id", "left_semi")

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows and returns them as stored."""
        written = self.store.write(name, rows)
        for bucket, segment in written.items():
            self.store.state[name, bucket] = (*self.store.state.get((name, bucket), ()), segment)
        return self._stored(name, written)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Puts rows in place of those of the touched packages; the other packages of the buckets keep theirs."""
        others = self.store.read(name, self.buckets).join(self.packages, "package_id", "left_anti")
        written = self.store.write(name, rows.select(*self.store.tables[name].columns).unionByName(others))
        for bucket in self.buckets:
            self.store.state.pop((name, bucket), None)
        for bucket, segment in written.items():
            self.store.state[name, bucket] = (segment,)
        return self.read(name)

    def _stored(self, name: str, written: dict[int, str]) -> DataFrame:
        places = [f"{self.store.path}/{name}/segment={segment}/bucket={bucket}" for bucket, segment in written.items()]
        schema = self.store.tables[name].schema
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)

    def _merge(self, name: str) -> None:
        """Merges segments of one level, level by level, in the touched buckets that have enough of them."""
        level = 0
        while True:
            ripe = {}
            for bucket in self.buckets:
                own = [s for s in self.store.state.get((name, bucket), ()) if s.startswith(f"{level}-")]
                if len(own) >= FAN:
                    ripe[bucket] = own
            if not ripe:
                return
            schema = self.store.tables[name].schema
            places = [f"{self.store.path}/{name}/segment={s}/bucket={b}" for b, segments in ripe.items() for s in segments]
            # one file a bucket and task: rows of a bucket are few enough to be read again by the next batch anyway
            rows = self.store.spark.read.schema(schema).parquet(*places)
            written = self.store.write(name, rows.repartition("package_id"), level + 1)
            for bucket, segments in ripe.items():
                kept = [s for s in self.store.state[name, bucket] if s not in segments]
                self.store.state[name, bucket] = (written[bucket], *kept)
            level += 1

    def publish(self) -> None:
        for name, table in self.store.tables.items():
            if not table.replaced:
                self._merge(name)
        self.store.publish(self.batch)

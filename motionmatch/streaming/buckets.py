"""A table in hash buckets of its key, for streams that add rows once and change rows later.

A manifest lists the folders of every bucket. A change writes the buckets it touches to new folders
and then a new manifest, so a reader sees all of it or nothing; a change that fails leaves files that
no manifest names. The manifest also holds the last micro-batch of every stream that was applied: a
replayed one is ignored. A table has one writer at a time; readers are free.

Beside a bucket's rows lies a Bloom filter of their keys (bitmaps of 32,768 bits, three bits a key).
Keys that miss it are new for certain; only buckets with a hit are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from motionmatch.sources.files import names, read_text, remove, write_text
from motionmatch.sources.scratch import scratch_path

BITS = 32_768            # of a bitmap aggregate
BITS_A_KEY = 16
HASHES = 3
MOST_PARTS = 8           # folders of a bucket before it is written as one


@dataclass(frozen=True)
class Applied:
    """What a change did; nothing if its micro-batch had been applied before."""
    version: int
    read: tuple[int, ...] = ()
    written: tuple[int, ...] = ()
    replayed: bool = False


def with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_bucket", IntegerType())])


class Buckets:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, count: int = 64) -> Buckets:
        if key not in schema.names or not 1 <= count <= 4096:
            raise ValueError("the key is a column, and there are 1 to 4096 buckets")
        write_text(spark, f"{path.rstrip('/')}/manifest/{0:012d}.json", json.dumps({
            "version": 0, "key": key, "count": count, "schema": schema.json(), "parts": {}, "applied": {}}))
        return cls(spark, path)

    def refresh(self) -> None:
        """The newest manifest."""
        found = [n for n in names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        self.manifest = json.loads(read_text(self.spark, f"{self.path}/manifest/{found[-1]}"))
        self.schema = StructType.fromJson(json.loads(self.manifest["schema"]))
        self.key, self.count = self.manifest["key"], self.manifest["count"]

    @property
    def parts(self) -> dict[str, dict[str, int]]:
        """bucket -> folder version -> bitmaps of its filter."""
        return self.manifest["parts"]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all or of the given buckets; others are not listed or opened."""
        folders = [f"{self.path}/rows/{v}/_bucket={b}" for b, versions in self.parts.items()
                   if buckets is None or int(b) in buckets for v in versions]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.count)).cast("int")

    def _placed(self, blocks: Column) -> list[Column]:
        """(bitmap, bit) of a key, as many times as there are hashes."""
        text = F.col(self.key).cast("string")
        block = F.pmod(F.xxhash64(text, F.lit("block")), blocks)
        return [F.struct(block.alias("block"), F.pmod(F.xxhash64(text, F.lit(k)), F.lit(BITS)).alias("bit")) for k in range(HASHES)]

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The rows, with ``_bucket``, whose key a filter of their bucket holds; some of them falsely."""
        parts = [(int(b), v, n) for b, versions in self.parts.items() for v, n in versions.items()]
        if not parts:
            return rows.limit(0)
        known = F.broadcast(self.spark.createDataFrame(parts, "_bucket int, _version string, _blocks int"))  # count x MOST_PARTS rows
        filters = self.spark.read.schema("block long, bitmap binary, _version string, _home int").parquet(
            *(f"{self.path}/filters/{v}/_bucket={b}" for b, v, _ in parts))
        asked = rows.select(self.key, "_bucket").distinct().join(known, "_bucket")
        asked = asked.withColumn("_places", F.array(*self._placed(F.col("_blocks")))).withColumn(
            "block", F.col("_places")[0]["block"])
        byte = lambda p: F.conv(F.hex(F.substring("bitmap", (F.floor(p["bit"] / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        held = F.forall("_places", lambda p: F.getbit(byte(p).cast("int"), F.pmod(p["bit"], F.lit(8)).cast("int")) == 1)
        hits = asked.withColumnRenamed("_bucket", "_home").join(filters, ["_home", "_version", "block"]).where(
            held).select(self.key).distinct()
        return rows.join(hits, self.key, "left_semi")

    def _write(self, rows: DataFrame, replace: list[int] | None, applied: dict[str, int], read: list[int]) -> Applied:
        """Rows to new folders: instead of the buckets in ``replace``, or beside what there is."""
        spark, version = self.spark, self.manifest["version"] + 1
        name = f"{version:012d}"
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/{name}")
        written = spark.read.schema(with_bucket(self.schema)).parquet(f"{self.path}/rows/{name}") \
            if names(spark, f"{self.path}/rows/{name}") else rows.limit(0)
        sizes = {r["_bucket"]: -(-r["n"] * BITS_A_KEY // BITS) for r in written.groupBy("_bucket").agg(
            F.count("*").alias("n")).collect()}                                    # a row a bucket
        if sizes:
            blocks = F.broadcast(spark.createDataFrame(list(sizes.items()), "_bucket int, _blocks int"))
            bits = written.select(self.key, "_bucket").join(blocks, "_bucket").select(
                "_bucket", F.explode(F.array(*self._placed(F.col("_blocks")))).alias("p"))
            bits.groupBy("_bucket", F.col("p.block").alias("block")).agg(
                F.bitmap_construct_agg("p.bit").alias("bitmap")).withColumns({"_version": F.lit(name), "_home": F.col("_bucket")}).write.mode(
                "overwrite").partitionBy("_bucket").parquet(f"{self.path}/filters/{name}")
        parts = {b: dict(v) for b, v in self.parts.items()}
        for b in replace or ():
            parts.pop(str(b), None)
        for b, n in sizes.items():
            parts.setdefault(str(b), {})[name] = n
        self.manifest = {**self.manifest, "version": version, "parts": parts, "applied": {**self.manifest["applied"], **applied}}
        write_text(spark, f"{self.path}/manifest/{name}.json", json.dumps(self.manifest))
        return Applied(version, tuple(sorted(read)), tuple(sorted(sizes)))

    def _replayed(self, stream: str, batch: int | None) -> bool:
        return batch is not None and batch <= self.manifest["applied"].get(stream, -1)

    def _settled(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "change")
        rows.withColumn("_bucket", self.bucket()).write.parquet(path)
        return self.spark.read.schema(with_bucket(rows.schema)).parquet(path)

    def append_once(self, rows: DataFrame, *, stream: str = "append", batch: int | None = None) -> Applied:
        """Adds the rows whose key the table does not hold; a stored row never changes."""
        self.refresh()
        if self._replayed(stream, batch):
            return Applied(self.manifest["version"], replayed=True)
        fresh = self._settled(rows.select(*self.schema.names).dropDuplicates([self.key]))
        doubtful = self.may_hold(fresh)
        read = [r[0] for r in doubtful.select("_bucket").distinct().collect()]     # at most a row a bucket
        if read:
            fresh = fresh.join(self.read(read).select(self.key), self.key, "left_anti")
        applied = {stream: batch} if batch is not None else {}
        done = self._write(fresh, None, applied, read)
        crowded = [int(b) for b, v in self.parts.items() if len(v) > MOST_PARTS]
        if crowded:
            self._write(self.read(crowded).withColumn("_bucket", self.bucket()), crowded, {}, crowded)
        return done

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, stream: str = "change",
               batch: int | None = None) -> tuple[Applied, DataFrame]:
        """(what was done, rows whose key the table does not hold). ``rows`` has one row a key; ``merge(old, rows)``
        gives the buckets' new rows from their old ones."""
        self.refresh()
        if self._replayed(stream, batch):
            return Applied(self.manifest["version"], replayed=True), rows.limit(0)
        changes = self._settled(rows)
        hits = [r[0] for r in self.may_hold(changes).select("_bucket").distinct().collect()]
        old = self.read(hits)
        known = changes.join(old.select(self.key), self.key, "left_semi")
        unknown = changes.join(old.select(self.key), self.key, "left_anti").drop("_bucket")
        touched = [r[0] for r in known.select("_bucket").distinct().collect()]
        new = merge(self.read(touched), known.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", self.bucket())
        # The old folders stay, so rejects and the rows that were read can be computed again.
        return self._write(new, touched, {stream: batch} if batch is not None else {}, hits), unknown

    def vacuum(self) -> int:
        """Removes the folders and manifests that the newest manifest does not need; for when no reader uses them."""
        self.refresh()
        needed = {v for versions in self.parts.values() for v in versions}
        gone = [f"{self.path}/{kind}/{v}" for kind in ("rows", "filters") for v in names(self.spark, f"{self.path}/{kind}")
                if v not in needed]
        gone += [f"{self.path}/manifest/{n}" for n in names(self.spark, f"{self.path}/manifest")
                 if n != f"{self.manifest['version']:012d}.json"]
        for folder in gone:
            remove(self.spark, folder)
        return len(gone)

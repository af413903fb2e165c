"""A table of versions on plain Parquet: upserts and deletes that write, commit once, and can be repeated.

* ``data/<unique folder>/quern_bucket=K``: the rows of a bucket, a hash of the key.
* ``log/<number>.json``: a version: its columns, the folder of each bucket, and the
  batches that it has taken in.

A write puts the buckets that it touches into a new folder and then creates the next
log file, which exists whole or not at all. Until then nobody reads the folder, so a
job that dies before loses nothing and leaves only a folder that ``vacuum`` removes; a
batch whose name the log already has is not taken in again, so a job that dies after
doubles nothing. Of two writers at once the later finds the number taken and starts again
from the other's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "quern_bucket"
#: Names of the last batches that a version remembers.
REMEMBERED = 1000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class VersionedTable:
    """Rows by key; reading gives one version, the last if none is named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = 64) -> VersionedTable:
        """An empty table, version 0; an existing one with the same columns is opened as it is."""
        table = cls(spark, path)
        schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        first = {"version": 0, "schema": schema.jsonValue(), "keys": list(keys), "buckets": buckets, "folders": {}, "batches": [], "batch": None}
        if BUCKET in schema.names or not set(keys) <= set(schema.names):
            raise ValueError("keys must be columns, and no column may be named " + BUCKET)
        try:
            table._commit(first)
        except Conflict:
            held = table._log(0)
            if held["schema"] != first["schema"] or held["keys"] != first["keys"]:
                raise ValueError(f"{path} holds another table") from None
        return table

    # The log.

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _log(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"log/{version:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return self.versions()[-1]

    def _commit(self, entry: dict) -> None:
        """Create the entry's log file: written aside first, then renamed, which fails if the name is taken."""
        aside, name = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{entry['version']:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, name, none)
        except Exception as error:
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {entry['version']} is taken") from None
            raise

    # Reading.

    def _read(self, entry: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        folders = [f"{self.path}/data/{folder}/{BUCKET}={k}" for k, folder in entry["folders"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._log(self.version() if version is None else version))

    def history(self) -> list[dict]:
        """Version, batch, and how many buckets it rewrote, of each version."""
        out, before = [], {}
        for n in self.versions():
            entry = self._log(n)
            out.append({"version": n, "batch": entry["batch"], "rewritten": sum(before.get(k) != f for k, f in entry["folders"].items())})
            before = entry["folders"]
        return out

    # Writing.

    def upsert(self, changes: DataFrame, batch: str, overwrite: Sequence[str] = (), order: str | None = None) -> int:
        """Take in ``changes``; returns the version that has them.

        A row's columns replace those of the row with its keys where they are not
        null, ``overwrite`` columns always; other rows are added. Of changes that
        repeat a key the one with the largest ``order`` counts, and of equal ones the
        one with the largest hash of its columns, so that a repeated job decides alike. Null
        keys are keys. ``batch`` names the changes: a name that the table has taken in
        before changes nothing.
        """
        return self._write(changes, batch, set(overwrite), order, delete=False)

    def delete(self, keys: DataFrame, batch: str) -> int:
        """Remove the rows with the keys of ``keys``."""
        return self._write(keys, batch, set(), None, delete=True)

    def _write(self, changes: DataFrame, batch: str, overwrite: set[str], order: str | None, delete: bool, tries: int = 20) -> int:
        for _ in range(tries):
            entry = self._log(self.version())
            if batch in entry["batches"]:
                return next(n for n in reversed(self.versions()) if self._log(n)["batch"] == batch)
            after = self._prepare(entry, changes, batch, overwrite, order, delete)
            try:
                self._commit(after)
                return after["version"]
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {tries} times")

    def _prepare(self, entry: dict, changes: DataFrame, batch: str, overwrite: set[str], order: str | None, delete: bool) -> dict:
        """Write the touched buckets' new rows and return the version that names them."""
        schema, keys, buckets = StructType.fromJson(entry["schema"]), entry["keys"], entry["buckets"]
        q = lambda c: F.col("`" + c.replace("`", "``") + "`")
        bucket = F.pmod(F.xxhash64(*map(q, keys)), F.lit(buckets)).cast("int")
        rest = [f.name for f in schema if f.name not in keys]
        columns = [(q(c) if c in changes.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.names]
        rank = (q(order) if order else F.lit(0)).alias("quern_order")
        new = changes.select(*columns, rank).withColumn(BUCKET, bucket)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # as many as the table has buckets, at most
        folder = uuid.uuid4().hex
        if touched:
            tie = F.xxhash64(F.to_json(F.struct(*map(q, schema.names)), {"ignoreNullFields": "false"}))
            one = F.struct(*[q(c) for c in rest], F.lit(1).alias("quern_new"))
            latest = F.max_by(F.when(F.col("quern_gen") == 1, one), F.when(F.col("quern_gen") == 1, F.struct("quern_order", "quern_tie")))
            old = F.any_value(F.when(F.col("quern_gen") == 0, F.struct(*[q(c) for c in rest], F.lit(1).alias("quern_new"))), F.lit(True))
            held = self._read(entry, touched).withColumn(BUCKET, bucket).select("*", F.lit(None).cast(new.schema["quern_order"].dataType).alias("quern_order"), F.lit(0).alias("quern_gen"), F.lit(0).cast("long").alias("quern_tie"))
            both = held.unionByName(new.select("*", F.lit(1).alias("quern_gen"), tie.alias("quern_tie")))
            # Dealt by bucket once: grouping by (bucket, keys) and writing by bucket need no other shuffle.
            merged = both.repartition(len(touched), BUCKET).groupBy(BUCKET, *map(q, keys)).agg(latest.alias("quern_n"), old.alias("quern_o"))
            pick = lambda c: F.when(F.col("quern_n").isNotNull(), F.col("quern_n")[c]).otherwise(F.col("quern_o")[c]) if c in overwrite else F.coalesce(F.col("quern_n")[c], F.col("quern_o")[c])
            if delete:
                merged = merged.where("quern_n IS NULL")
            merged.select(BUCKET, *map(q, keys), *[pick(c).alias(c) for c in rest]).select(*map(q, schema.names), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        kept = [k for k in touched if self._fs.exists(self._at(f"data/{folder}/{BUCKET}={k}"))]
        folders = {k: f for k, f in entry["folders"].items() if int(k) not in touched} | {str(k): folder for k in kept}
        return {**entry, "version": entry["version"] + 1, "folders": folders, "batch": batch, "batches": [*entry["batches"], batch][-REMEMBERED:]}

    def vacuum(self) -> int:
        """Remove the folders that no version names, such as those of jobs that died; run it while nobody writes. Returns their number."""
        named = {f for n in self.versions() for f in self._log(n)["folders"].values()}
        there = [s.getPath() for s in self._fs.listStatus(self._at("data"))] if self._fs.exists(self._at("data")) else []
        gone = [p for p in there if p.getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

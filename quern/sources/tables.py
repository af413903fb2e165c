"""Sources and sinks: tables, files, and upserts expressed as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_metadata(spark: SparkSession, path: str, schema=None, key: Sequence[str] = ("path", "title")) -> DataFrame:
    """A Parquet metadata file with NaN read as null, keyed by the first column of ``key`` that is set."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*clean).withColumn("key", F.coalesce(*[F.col(k).cast("string") for k in key if k in df.columns], F.monotonically_increasing_id().cast("string")))


def read_partition(spark: SparkSession, path: str, year: int) -> DataFrame:
    """One ``year=`` partition of a partitioned folder; the others are pruned before any file is listed for reading."""
    return spark.read.parquet(path).where(F.col("year") == year)


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, stem, length) of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "length")


def _lengths(names: DataFrame) -> list[int]:
    """The different lengths of names, as many as the longest name has letters at most."""
    return sorted(r[0] for r in names.select(F.length("name")).distinct().collect())


def _pieces(name: Column, lengths: list[int]) -> Column:
    """The different pieces of a name that are as long as one of ``lengths``."""
    asked = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda k: k <= F.length(name))
    return F.array_distinct(F.flatten(F.transform(asked, lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(name, i, k)))))


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): the names of ``inner`` that names of ``outer`` hold; both without repeats or nulls."""
    pieces = outer.select(F.col("name").alias("outer"), F.explode(_pieces(F.col("name"), _lengths(inner))).alias("piece"))
    return pieces.join(inner.hint("merge"), F.col("piece") == F.col("name")).select(F.col("name").alias("inner"), "outer")


def match_files(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files(stem) with metadata(key, ..): by stem, else by stem without a ``_XX`` language ending, else by containment either way, the smallest key.

    Only stems that neither equality matched take part in the last step. A name that
    another holds equals one of its pieces, so containment is an equality join of
    names with pieces as long as some name: a row for each place in a name and each
    such length, however many names look alike. All joins are by shuffle, so no side
    passes through the driver.
    """
    keyed = metadata.withColumnRenamed("key", "meta_key")
    stems = settle(files.select("stem").where("stem IS NOT NULL").distinct(), "stems")
    keys = settle(keyed.select(F.col("meta_key").alias("name")).where("name IS NOT NULL").distinct(), "names")
    # The stem itself and without its ending are two rows, so one join is enough for both.
    asked = stems.select("stem", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("stem").alias("said")), F.struct(F.lit(2).alias("tier"), F.regexp_replace("stem", "_[A-Z]{2}$", "").alias("said")))).alias("a"))
    equal = asked.select("stem", "a.tier", "a.said").join(keys.hint("merge"), F.col("said") == F.col("name")).groupBy("stem").agg(F.min(F.struct("tier", F.col("name").alias("meta_key"))).alias("m"))
    equal = settle(equal.select("stem", "m.meta_key", "m.tier"), "equal-names")
    rest = settle(stems.join(equal.select("stem").hint("merge"), "stem", "left_anti").withColumnRenamed("stem", "name"), "unlike-names")
    within = _inside(keys, rest).select(F.col("outer").alias("stem"), F.col("inner").alias("meta_key")).unionByName(_inside(rest, keys).select(F.col("inner").alias("stem"), F.col("outer").alias("meta_key")))
    within = within.groupBy("stem").agg(F.min("meta_key").alias("meta_key")).withColumn("tier", F.lit(3))
    best = equal.unionByName(within).withColumnRenamed("stem", "of")
    found = files.join(best.hint("merge"), F.col("stem") == F.col("of"), "left").drop("of")
    return found.withColumnRenamed("meta_key", "said").join(keyed.hint("merge"), F.col("said") == F.col("meta_key"), "left").drop("said").withColumn("tier", F.coalesce("tier", F.lit(0)))


def read_records(spark: SparkSession, path: str, names: dict[str, Sequence[str]], lines: bool = False) -> DataFrame:
    """JSON arrays of records (or ``lines`` of one each) with differing field names: each output column is the first of its aliases that is set."""
    df = spark.read.option("multiLine", str(not lines).lower()).json(path)
    column = lambda options: F.coalesce(*[F.col(o).cast("string") for o in options if o in df.columns], F.lit(None).cast("string"))
    return df.select(*[column(options).alias(name) for name, options in names.items()])


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """One table of sources with differing columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_sections(texts: DataFrame, text: str = "text", heading: str = r"(?m)^(?=\d+[A-Z]{0,2}\. )") -> DataFrame:
    """One row per numbered section of a statute's text: section_number, section_text."""
    parts = texts.withColumn("part", F.explode(F.split(text, heading))).where(F.col("part").rlike(r"^\d"))
    return parts.select(*[c for c in texts.columns if c != text], F.regexp_extract("part", r"^(\d+[A-Z]{0,2})\.", 1).alias("section_number"), F.regexp_replace("part", r"^\d+[A-Z]{0,2}\.\s*|\s+$", "").alias("section_text"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line and row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def page(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> DataFrame:
    """Rows of one page of a total order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


# Upserts. There is no MERGE on plain Parquet: the new state of a table is a join of the old state and the changes.


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` column by column where they are not null; ``overwrite`` columns always."""
    o, n = old.alias("o"), new.withColumn("quern_new", F.lit(True)).alias("n")
    both = o.join(n, list(keys), "full")
    pick = lambda c: F.when(F.col("quern_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in overwrite else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` does not have are added, of equal keys one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti"), allowMissingColumns=True)


def replace_latest(parts: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """The row of the largest ``version`` for each key, by aggregation rather than by sorting whole groups."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*").select(parts.columns)


def delete_stale(rows: DataFrame, stale: Column, keep_ids: DataFrame, key: str) -> DataFrame:
    """Rows that match ``stale`` go unless ``keep_ids`` has their key."""
    kept = keep_ids.select(F.col(key)).distinct().withColumn("quern_keep", F.lit(True))
    return rows.join(kept, key, "left").where(~F.coalesce(stale, F.lit(False)) | F.coalesce("quern_keep", F.lit(False))).drop("quern_keep")


def purge(tables: dict[str, DataFrame], bad_ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: df.join(bad_ids.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def unnest_children(parents: DataFrame, key: str, array: str) -> DataFrame:
    """Child rows out of an array of structs, tagged with their parent's key and their place."""
    return parents.select(key, F.posexplode(array).alias("place", "child")).select(key, "place", "child.*")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of two copies of a table with ``only_left``, ``only_right``, ``differs`` or ``same``, compared by row fingerprints."""
    common = [c for c in left.columns if c in right.columns and c != key]
    mark = lambda df, name: df.select(key, F.xxhash64(*common).alias(name))
    both = mark(left, "l").join(mark(right, "r"), key, "full")
    return both.select(key, F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("l") != F.col("r"), "differs").otherwise("same").alias("status"))

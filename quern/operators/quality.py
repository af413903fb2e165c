"""Quality gates, audits and comparisons with a gold set; each is one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scores import is_filled


def _report(checks: Mapping[str, tuple[Column, Column]]) -> Column:
    """rows (check, value, status) out of one row of numbers: (value, status) of each check."""
    return F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.round(value, 4).alias("value"), status.alias("status")) for name, (value, status) in checks.items()]))


def _at_least(value: Column, fail: float, warn: float | None = None) -> Column:
    status = F.when(value < fail, "fail")
    return (status.when(value < warn, "warn") if warn is not None else status).otherwise("pass")


def _at_most(value: Column, fail: float | None, warn: float) -> Column:
    status = F.when(value > fail, "fail").when(value > warn, "warn") if fail is not None else F.when(value > warn, "warn")
    return status.otherwise("pass")


def batch_gate(records: DataFrame, required: Sequence[str], unique: Mapping[str, float], year: str = "year", span: tuple[int, int] = (1947, 2027)) -> DataFrame:
    """(check, value, status): coverage of required fields, distinctness of others, rows out of the span of years, distinct whole records.

    Coverage under 85 % fails, under 95 % warns; distinctness counts only beyond
    ten rows; distinct rows are told by 64-bit hashes. An empty batch fails.
    """
    aggs = [F.count("*").alias("total"), *[F.count_if(is_filled(records, c)).alias(f"has_{c}") for c in required], F.count_if(~F.col(year).between(*span)).alias("odd_years"), F.count_distinct(F.xxhash64(*records.columns)).alias("blobs")]
    for c in unique:
        own = F.when(is_filled(records, c), F.xxhash64(F.col(c)))
        aggs += [F.count(own).alias(f"n_{c}"), F.count_distinct(own).alias(f"u_{c}")]
    total = F.greatest(F.col("total"), F.lit(1))
    checks = {"rows": (F.col("total").cast("double"), F.when(F.col("total") == 0, "fail").otherwise("pass"))}
    checks |= {f"has_{c}": (F.col(f"has_{c}") / total, _at_least(F.col(f"has_{c}") / total, 0.85, 0.95)) for c in required}
    for c, least in unique.items():
        share = F.col(f"u_{c}") / F.greatest(F.col(f"n_{c}"), F.lit(1))
        checks[f"unique_{c}"] = (share, F.when(F.col(f"n_{c}") <= 10, "pass").otherwise(_at_least(share, least)))
    checks["odd_years"] = (F.col("odd_years").cast("double"), _at_most(F.col("odd_years"), None, 0))
    checks["unique_records"] = (F.col("blobs") / total, F.when(F.col("total") <= 10, "pass").otherwise(_at_least(F.col("blobs") / total, 0.9)))
    return records.agg(*aggs).select(_report(checks).alias("r")).select("r.*")


def content_gate(records: DataFrame, rates: Mapping[str, tuple[Column, float | None, float]]) -> DataFrame:
    """(check, value, status): shares of rows for which a condition holds, each with a failing and a warning share."""
    counts = records.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"), *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, (cond, _, _) in rates.items()])
    checks = {name: (F.col(name) / F.col("total"), _at_most(F.col(name) / F.col("total"), fail, warn)) for name, (_, fail, warn) in rates.items()}
    return counts.select(_report(checks).alias("r")).select("r.*")


def row_audit(rows: DataFrame, key: str, critical: Mapping[str, Column], high: Mapping[str, Column], medium: Mapping[str, Column]) -> DataFrame:
    """(key, issues, severity): what is wrong with each row, and how badly."""
    flags = {**critical, **high, **medium}
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags.items()]))
    any_of = lambda some: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in some.values()], F.lit(False))
    severity = F.when(any_of(critical), "CRITICAL").when(any_of(high), "HIGH").when(any_of(medium), "MEDIUM").otherwise("CLEAN")
    return rows.select(key, F.array_join(issues, ",").alias("issues"), severity.alias("severity"))


def row_gate(rows: DataFrame, key: str, pieces: Column, vectors: Column, title: Column, dimension: int) -> DataFrame:
    """(key, passed, failures): pieces 1 to 500, as many vectors, of the right dimension (the first three are looked at), a title."""
    wrong = {"no_pieces": F.size(pieces) == 0, "many_pieces": F.size(pieces) > 500, "vector_count": F.size(vectors) != F.size(pieces), "dimension": F.exists(F.slice(vectors, 1, 3), lambda v: F.size(v) != dimension), "no_title": F.coalesce(F.trim(title), F.lit("")) == ""}
    failures = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in wrong.items()]))
    return rows.select(key, (F.size(failures) == 0).alias("passed"), F.array_join(failures, ",").alias("failures"))


def precision_recall(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of a binary judgement."""
    counts = rows.agg(F.count_if(predicted & gold).alias("tp"), F.count_if(predicted & ~gold).alias("fp"), F.count_if(~predicted & gold).alias("fn"))
    p, r = (F.col("tp") / F.greatest(F.col("tp") + F.col(x), F.lit(1)) for x in ("fp", "fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def list_agreement(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """(key, tp, fp, fn) of two arrays as sets, ignoring case."""
    low = lambda c: F.array_distinct(F.transform(F.col(c), lambda x: F.lower(F.trim(x))))
    both = F.size(F.array_intersect(low(predicted), low(gold)))
    return rows.select(key, both.alias("tp"), (F.size(low(predicted)) - both).alias("fp"), (F.size(low(gold)) - both).alias("fn"))


def shared_values(rows: DataFrame, key: str, column: str, least: int = 30) -> DataFrame:
    """(key, others): rows whose text of ``least`` characters or more stands in other rows too.

    Texts are compared by SHA-256, counted by group and joined back by hash, so a
    value that very many rows share is one row on one side of the join.
    """
    marked = rows.where(F.length(column) >= least).select(key, F.sha2(column, 256).alias("mark"))
    groups = marked.groupBy(F.col("mark").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    return marked.join(groups, F.col("mark") == F.col("of")).select(key, (F.col("n") - 1).alias("others"))


def store_check(ids: DataFrame, key: str, stores: Mapping[str, DataFrame], least: float = 0.9) -> DataFrame:
    """(store, found, share, status): how many of the ids each store has."""
    out = ids.select(key).distinct()
    for name, df in stores.items():
        out = out.join(df.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    sums = out.agg(F.count("*").alias("total"), *[F.count(name).alias(name) for name in stores])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("store"), F.col(name).alias("found")) for name in stores])).alias("s")
    share = F.col("s.found") / F.greatest(F.col("total"), F.lit(1))
    return sums.select("total", rows).select("s.store", "s.found", F.round(share, 4).alias("share"), F.when(share < least, "fail").otherwise("pass").alias("status"))


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that look random but are the same each time: those with the smallest hash of key and seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def changed_rows(rows: DataFrame, key: str, repaired: Mapping[str, Column]) -> DataFrame:
    """The rows that a repair changes, with the new values."""
    new = rows.select(key, *[F.col(c).alias(f"old_{c}") for c in repaired], *[v.alias(c) for c, v in repaired.items()])
    differs = reduce(lambda a, b: a | b, [~F.col(f"old_{c}").eqNullSafe(F.col(c)) for c in repaired])
    return new.where(differs).select(key, *repaired)

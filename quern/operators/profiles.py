"""Profiles, rates, trends and head-to-head records over a table of cases.

A case has scalar columns and arrays of members (judges), acts, and counsel
(structs of side and name). All functions take and return DataFrames and need
one pass and one shuffle each unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIN = {"petitioner": ("allowed", "partly allowed"), "respondent": ("dismissed",)}


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part / whole, digits)


def is_win(side: Column, disposal: Column) -> Column:
    """Whether the outcome is a win for the side; false where there is none."""
    won = F.lit(False)
    for name, outcomes in WIN.items():
        won = F.when(side == name, F.lower(disposal).isin(*outcomes)).otherwise(won)
    return F.coalesce(won, F.lit(False))


def list_members(cases: DataFrame, members: str, author: str, page: int = 1, size: int = 20) -> DataFrame:
    """member, cases, authored, total_pages: most cases first, one page."""
    rows = cases.select(F.explode(members).alias("member"), author)
    counted = rows.groupBy("member").agg(F.count("*").alias("cases"), F.count_if(F.col(author) == F.col("member")).alias("authored"))
    pages = counted.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("total_pages"))
    top = counted.orderBy(F.desc("cases"), "member").offset((page - 1) * size).limit(size)
    return top.join(F.broadcast(pages))  # one row


def value_counts(cases: DataFrame, columns: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """facet, value, n for several columns in one pass, nulls and blanks left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = cases.select(*per, F.explode(pairs).alias("p")).where(F.coalesce(F.col("p.value"), F.lit("")) != "")
    return rows.groupBy(*per, F.col("p.facet").alias("facet"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def member_profile(cases: DataFrame, member, members: str = "judge", author: str = "author") -> DataFrame:
    """All sub-aggregates of a member's cases as rows (facet, value, n): totals, years, outcomes, types, acts, colleagues."""
    own = cases.where(F.array_contains(members, member))
    totals = own.agg(F.count("*").alias("cases"), F.count_if(F.col(author) == member).alias("authored"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.lit("all").alias("value"), F.col(c).alias("n")) for c in ("cases", "authored")])).alias("p")).select("p.*")
    scalar = value_counts(own, ["year", "disposal", "case_type"])
    acts = own.select(F.explode("acts").alias("value")).groupBy(F.lit("act").alias("facet"), "value").agg(F.count("*").alias("n"))
    peers = own.select(F.explode(F.transform(F.filter(members, lambda x: x != member), lambda x: x.cast("string"))).alias("value")).groupBy(F.lit("colleague").alias("facet"), "value").agg(F.count("*").alias("n"))
    return totals.unionByName(scalar).unionByName(acts).unionByName(peers)


def compare_members(cases: DataFrame, names: Sequence, members: str = "judge", author: str = "author") -> DataFrame:
    """cases, authored, allowed percentage of two or three members side by side, in one pass."""
    if not 2 <= len(names) <= 3:
        raise ValueError("two or three members are compared")
    rows = cases.select(F.explode(members).alias("member"), author, "disposal").where(F.col("member").isin(*names))
    return rows.groupBy("member").agg(F.count("*").alias("cases"), F.count_if(F.col(author) == F.col("member")).alias("authored"), percent(F.count_if(F.col("disposal") == "allowed"), F.count("*")).alias("allowed_pct"))


def rates(cases: DataFrame, column: str, per: Sequence[str] = ()) -> DataFrame:
    """value, n, pct: shares of the lower-cased, trimmed values among all rows, those without one included."""
    value = F.lower(F.trim(F.col(column)))
    # Count first, then relate the counts: a window over groups, never over rows.
    counted = cases.groupBy(*per, value.alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*per)) if per else None
    if total is None:
        whole = cases.agg(F.count("*").alias("total"))
        counted = counted.join(F.broadcast(whole))
    else:
        counted = counted.withColumn("total", total)
    return counted.where("value IS NOT NULL").select(*per, "value", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def trends(cases: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """year, total, allowed, dismissed, allowed_pct; the year of the decision date, else the year column."""
    year = F.coalesce(F.year("decision_date"), F.col("year"))
    allowed, dismissed = (F.count_if(F.lower("disposal") == x) for x in ("allowed", "dismissed"))
    return cases.groupBy(*per, year.alias("year")).agg(F.count("*").alias("total"), allowed.alias("allowed"), dismissed.alias("dismissed"), percent(allowed, F.count("*")).alias("allowed_pct"))


def group_stats(cases: DataFrame, group: str) -> DataFrame:
    """One row per group: total, first and last year, outcome counts, mean value."""
    return cases.groupBy(group).agg(
        F.count("*").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        *[F.count_if(F.col("disposal") == o).alias(o.replace(" ", "_")) for o in ("allowed", "dismissed", "partly allowed")],
        percent(F.count_if(F.col("disposal") == "allowed"), F.count("*")).alias("allowed_pct"),
    )


def cooccurrence(cases: DataFrame, members: str = "judge") -> DataFrame:
    """a, b, n for a < b: cases in which both sit. Pairs are made inside a case's array, whose size the data bound."""
    pairs = F.flatten(F.transform(members, lambda a: F.transform(F.filter(members, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return cases.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def head_to_head(cases: DataFrame, counsel: str = "counsel") -> DataFrame:
    """name, opponent, total, wins, losses, win_rate for every pair that met on opposite sides."""
    opposed = F.flatten(F.transform(counsel, lambda a: F.transform(F.filter(counsel, lambda b: b["side"] != a["side"]), lambda b: F.struct(a["name"].alias("name"), a["side"].alias("side"), b["name"].alias("opponent")))))
    rows = cases.select("disposal", F.explode(opposed).alias("m")).where("m.name <> m.opponent")
    won = is_win(F.col("m.side"), F.col("disposal"))
    wins = F.count_if(won)
    return rows.groupBy(F.col("m.name").alias("name"), F.col("m.opponent").alias("opponent")).agg(
        F.count("*").alias("total"), wins.alias("wins"), F.count_if(~won & F.col("disposal").isNotNull()).alias("losses"), percent(wins, F.count("*")).alias("win_rate")
    )


def counsel_list(cases: DataFrame, counsel: str = "counsel") -> DataFrame:
    """name, cases, side: distinct cases and the side taken most, of equal counts the alphabetically first."""
    rows = cases.select("case_id", F.explode(counsel).alias("c")).select("case_id", "c.name", "c.side")
    sides = rows.groupBy("name", "side").agg(F.count("*").alias("n"))
    usual = sides.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "side")).alias("m")).select("name", F.col("m.side").alias("usual_side"))
    return rows.groupBy("name").agg(F.count_distinct("case_id").alias("cases")).join(usual, "name")


def counsel_profile(cases: DataFrame, counsel: str = "counsel") -> DataFrame:
    """name, per-side counts, win rate among rows with an outcome, first and last year."""
    rows = cases.select("year", "disposal", F.explode(counsel).alias("c"))
    wins, decided = F.count_if(is_win(F.col("c.side"), F.col("disposal"))), F.count_if(F.col("disposal").isNotNull())
    return rows.groupBy(F.col("c.name").alias("name")).agg(
        F.count_if(F.col("c.side") == "petitioner").alias("as_petitioner"), F.count_if(F.col("c.side") == "respondent").alias("as_respondent"),
        F.when(decided > 0, percent(wins, decided)).otherwise(0.0).alias("win_rate"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group with their ``rank``; Spark keeps n rows a group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def predict_outcome(cases: DataFrame, members: Sequence, case_type: str, as_of: str, acts: Sequence[str] = ()) -> DataFrame:
    """outcome, probability, sample_size, confidence from the record of the first member for a case type.

    Cases of the last 3 x 365 days before ``as_of`` count twice. Up to three acts
    with five cases or more are blended in, in turn, with weight min(cases / 30,
    0.4); probabilities are rounded to 4 digits at each step. Fewer than three
    cases give no rows; under ten the confidence is 0.4 at most.
    """
    own = cases.where(F.array_contains("judge", members[0]) & F.col("disposal").isNotNull())
    weight = F.when(F.col("decision_date") >= F.date_sub(F.lit(as_of).cast("date"), 3 * 365), 2.0).otherwise(1.0)
    base = own.where(F.col("case_type") == case_type).groupBy("disposal").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    # From here on there is a row per outcome.
    every = Window.partitionBy()
    p = base.withColumn("p", F.round(F.col("w") / F.sum("w").over(every), 4)).withColumn("size", F.sum("n").over(every)).select("disposal", "p", "size")
    for act in acts[:3]:
        seen = own.where(F.array_contains("acts", act)).groupBy("disposal").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(every))
        both = p.join(seen, "disposal", "full")
        t = F.max("t").over(every)
        blend = F.when(t >= 5, F.least(t / 30.0, F.lit(0.4))).otherwise(0.0)
        p = both.withColumn("blend", blend).withColumn("size", F.max("size").over(every)).where("p IS NOT NULL OR blend > 0")
        mixed = F.round(F.coalesce("p", F.lit(0.0)) * (1 - F.col("blend")) + F.coalesce(F.col("c") / F.col("t"), F.lit(0.0)) * F.col("blend"), 4)
        p = p.select("disposal", F.when(F.col("blend") > 0, mixed).otherwise(F.col("p")).alias("p"), "size")
    sure = F.round(0.6 * F.max("p").over(every) + 0.4 * F.least(F.col("size") / 50.0, F.lit(1.0)), 4)
    sure = F.when(F.col("size") < 10, F.least(sure, F.lit(0.4))).otherwise(sure)
    return p.where("size >= 3").select(F.col("disposal").alias("outcome"), F.col("p").alias("probability"), F.col("size").alias("sample_size"), sure.alias("confidence"))


# Coverage and dashboards.


def filled(df: DataFrame, column: str) -> Column:
    """Not null and, for arrays and strings, not empty."""
    kind = df.schema[column].dataType.typeName()
    known = F.col(column).isNotNull()
    return known & (F.size(column) > 0) if kind == "array" else known & (F.trim(column) != "") if kind == "string" else known


def field_population(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """field, filled, rate: one pass over the table, one row per column."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(filled(df, c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    return counts.select("total", F.explode(pairs).alias("p")).select("p.field", "p.filled", F.round(F.col("p.filled") / F.greatest(F.col("total"), F.lit(1)), digits).alias("rate"))


def average_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """avg_filled: the mean number of filled columns."""
    return df.agg(F.round(F.avg(reduce(lambda a, b: a + b, [filled(df, c).cast("int") for c in columns])), 2).alias("avg_filled"))


def buckets(df: DataFrame, column: str, bounds: Sequence[float] = (0.3, 0.5, 0.7, 0.85)) -> DataFrame:
    """bucket, n: rows below each bound, from the last on, and without a value."""
    label = F.when(F.col(column).isNull(), "null")
    for bound in bounds:
        label = label.when(F.col(column) < bound, f"<{bound:g}")
    return df.groupBy(label.otherwise(f">={bounds[-1]:g}").alias("bucket")).agg(F.count("*").alias("n"))


def newest_years(df: DataFrame, n: int = 50) -> DataFrame:
    return df.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("cases")).orderBy(F.desc("year")).limit(n)


def global_facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value): the distinct values of each column, and ``min_year`` and ``max_year``; however many, no row holds them all."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    span = df.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    return values.unionByName(span.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("min_year", "max_year")])).alias("p")).select("p.*"))


def outcome_bias(results: DataFrame, query: str, top: int = 10) -> DataFrame:
    """warning: whether a bail or sentence query's top results with an outcome, two at least, all share one."""
    asks = any(w in query.lower() for w in ("bail", "sentence", "sentencing"))
    first = results.orderBy("rank").limit(top)
    return first.agg((F.lit(asks) & (F.count("disposal") >= 2) & (F.count_distinct("disposal") == 1)).alias("warning"))


def year_audit(cases: DataFrame, score: Column, text: Column) -> DataFrame:
    """One row per year: rows, fill rates, score and text-length spans, health, and the list of what is wrong."""
    agg = cases.groupBy("year").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("disposal").isNotNull().cast("int")), 2).alias("outcome_rate"), F.round(F.avg(F.coalesce((F.size("acts") > 0).cast("int"), F.lit(0))), 2).alias("acts_rate"),
        F.round(F.avg(score), 4).alias("score_avg"), F.round(F.min(score), 4).alias("score_min"), F.round(F.max(score), 4).alias("score_max"), F.max(F.length(text)).alias("longest"),
    )
    wrong = F.array_compact(F.array(F.when(F.col("outcome_rate") < 0.85, "outcomes"), F.when(F.col("acts_rate") < 0.85, "acts"), F.when(F.col("score_min") < 0.3, "scores")))
    health = F.round(0.5 * F.col("outcome_rate") + 0.3 * F.col("acts_rate") + 0.2 * F.least(F.col("score_avg") / 0.9, F.lit(1.0)), 2)
    return agg.withColumn("health", health).withColumn("anomalies", F.array_join(wrong, ","))

"""Validation, merging and scoring rules as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each filled field adds to the confidence of a record.
FIELD_WEIGHTS = {
    "title": 0.12, "citation": 0.12, "court": 0.10, "year": 0.10, "judge": 0.08, "decision_date": 0.06, "petitioner": 0.05, "respondent": 0.05, "ratio_decidendi": 0.08,
    "acts_cited": 0.05, "cases_cited": 0.05, "keywords": 0.04, "case_type": 0.03, "disposal_nature": 0.03, "bench_type": 0.02, "jurisdiction": 0.02,
}
#: Words that stand for no value.
BLANKS = ("nan", "nat", "none", "null", "")
#: Ranks of benches, numbers for strengths, weights of the composite confidence.
BENCH_RANKS = {"constitutional": 4, "full": 3, "division": 2, "single": 1}
STRENGTHS = {"BINDING": 1.0, "PERSUASIVE": 0.7, "DISTINGUISHABLE": 0.4, "OVERRULED": 0.1}
CONFIDENCE_WEIGHTS = {"relevance": 0.25, "coverage": 0.10, "authority": 0.15, "contradiction": 0.10, "diversity": 0.10, "gaps": 0.10, "synthesis": 0.20}
#: Old criminal codes and those that replaced them in 2024.
NEW_TO_OLD = {"BNS": "IPC", "BNSS": "CRPC", "BSA": "IEA"}


def is_filled(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    known = F.col(column).isNotNull()
    return known & (F.size(column) > 0) if kind == "array" else known & (F.trim(column) != "") if kind == "string" else known


def clean_value(column: Column | str) -> Column:
    """Trimmed text; null where it stands for no value."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(~F.lower(text).isin(*BLANKS), text)


def clean_year(column: Column, least: int = 1800, most: int = 2200) -> Column:
    year = column.cast("string").try_cast("int")
    return F.when(year.between(least, most), year)


def record_confidence(df: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS) -> Column:
    """Sum of the weights of the filled fields that the table has, at most 1, three digits."""
    parts = [F.when(is_filled(df, c), int(round(w * 100))).otherwise(0) for c, w in weights.items() if c in df.columns]
    return F.round(F.least(reduce(lambda a, b: a + b, parts, F.lit(0)) / 100, F.lit(1.0)), 3)


def gate(confidence: Column, value: Column, least: float = 0.4) -> Column:
    """A value that is dropped where confidence is below ``least``."""
    return F.when(confidence >= least, value)


def record_status(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "needs_review").otherwise("completed")


def merge_fields(df: DataFrame, first: str, second: str, prefer_second: Sequence[str], fields: Sequence[str]) -> list[Column]:
    """Merged columns of two sources, columns ``{first}_x`` and ``{second}_x``, and a map from field to its source."""
    out, sources = [], []
    for field in fields:
        a, b = (clean_value(F.col(f"{s}_{field}").cast("string")) for s in ((second, first) if field in prefer_second else (first, second)))
        names = (second, first) if field in prefer_second else (first, second)
        out.append(F.coalesce(a, b).alias(field))
        sources += [F.lit(field), F.when(a.isNotNull(), names[0]).when(b.isNotNull(), names[1])]
    return [*out, F.map_filter(F.create_map(*sources), lambda _, v: v.isNotNull()).alias("provenance")]


def bench_of(size: Column) -> Column:
    """The bench that a number of judges makes, as records are validated: 1, 2-3, 4, 5 or more."""
    return F.when(size >= 5, "constitutional").when(size == 4, "full").when(size.isin(2, 3), "division").when(size == 1, "single")


def bench_rank(bench: Column, size: Column) -> Column:
    """Rank for comparing benches: by number of judges where known (3 count as full), else by name."""
    named = F.lit(0)
    for name, rank in BENCH_RANKS.items():
        named = F.when(bench == name, rank).otherwise(named)
    return F.when(size >= 5, 4).when(size >= 3, 3).when(size == 2, 2).when(size == 1, 1).otherwise(named)


def fix_record(year: Column, day: Column, bench: Column, size: Column) -> list[Column]:
    """year from the decision date where both are known; bench from the number of judges."""
    return [F.when(year.isNotNull() & day.isNotNull(), F.year(day)).otherwise(year).alias("year"), F.coalesce(bench_of(size), bench).alias("bench_type")]


def grounded(words: Column, text: Column) -> Column:
    """The keywords of which at least one word of four letters or more is in the text."""
    low = F.lower(text)
    return F.filter(words, lambda k: F.exists(F.split(F.lower(k), r"\s+"), lambda w: (F.length(w) >= 4) & F.contains(low, w)))


def in_header(names: Column, text: Column, header: int = 2000) -> Column:
    """The names whose longest word of four letters or more is in the head of the text."""
    head = F.upper(F.substring(text, 1, header))

    def longest(name: Column) -> Column:
        words = F.filter(F.split(F.upper(name), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
        return F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))

    return F.filter(names, lambda n: (longest(n) != "") & F.contains(head, longest(n)))


def precedent_strength(level: Column, target_level: Column, same_court: Column, rank: Column, target_rank: Column, overruled: Column) -> Column:
    """BINDING, PERSUASIVE or OVERRULED of a precedent for a court; a null target level asks in general."""
    outranked = F.when(rank >= target_rank, "BINDING").otherwise("PERSUASIVE")
    top = F.when((target_level == "supreme") & (target_rank > 0), outranked).otherwise("BINDING")
    high = F.when(target_level.isNull() | ~F.coalesce(same_court, F.lit(False)), "PERSUASIVE").when((rank == 0) & (target_rank == 0), "BINDING").otherwise(outranked)
    return F.when(F.coalesce(overruled, F.lit(False)), "OVERRULED").when(level == "supreme", top).when(level == "high", high).otherwise("PERSUASIVE")


def recency(year: Column, now: int) -> Column:
    return F.when(year.isNull(), 1.0).otherwise(1.0 / (1 + F.greatest(F.lit(0), now - year) / 10))


def effective_strength(strength: Column, overruled: Column, year: Column, reportable: Column, now: int, sure: float = 0.7) -> Column:
    """Strength times what is left after overruling, times recency, a tenth more if reported; from 0 to 1."""
    base = F.lit(0.4)
    for name, value in STRENGTHS.items():
        base = F.when(strength == name, value).otherwise(base)
    left = F.when(F.coalesce(overruled, F.lit(False)), base * (1 - sure)).otherwise(base) * recency(year, now)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.coalesce(reportable, F.lit(False)), left * 1.1).otherwise(left)))


def composite_confidence(relevance: Column, coverage: Column, authority: Column, contradictions: Column, total: Column, tiers: Column, gaps: Column, gaps_left: Column, synthesis: Column) -> Column:
    """Weighted confidence of an answer from its parts; 0 without results."""
    one = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    parts = {
        "relevance": relevance, "coverage": F.least(coverage, F.lit(1.0)), "authority": authority, "contradiction": F.when(contradictions > 0, F.greatest(F.lit(0.0), 1 - contradictions / total)).otherwise(1.0),
        "diversity": F.least(tiers / 4, F.lit(1.0)), "gaps": F.when(gaps == 0, 1.0).otherwise(one((gaps - gaps_left) / gaps)), "synthesis": one(synthesis),
    }
    return F.when(total == 0, 0.0).otherwise(one(reduce(lambda a, b: a + b, [CONFIDENCE_WEIGHTS[k] * v for k, v in parts.items()])))


def cross_references(acts: Column, year: Column) -> Column:
    """Sorted act codes: before 2024 new codes become old ones; from then on, or without a year, both are listed."""
    old, both = acts, acts
    for new, was in NEW_TO_OLD.items():
        old = F.array_union(F.array_remove(old, new), F.when(F.array_contains(acts, new), F.array(F.lit(was))).otherwise(F.array().cast("array<string>")))
        both = F.array_union(both, F.when(F.array_contains(acts, new), F.array(F.lit(was))).when(F.array_contains(acts, was), F.array(F.lit(new))).otherwise(F.array().cast("array<string>")))
    return F.sort_array(F.array_distinct(F.when(year < 2024, old).otherwise(both)))


def deadline(start: Column, years: Column, months: Column, days: Column) -> Column:
    """The start plus 365 days a year, 30 a month and the days; null where that is nothing."""
    total = (years * 365 + months * 30 + days).cast("int")
    return F.when(total > 0, F.date_add(start, total))


def court_fee(valuation: Column, state: Column, level: Column, kind: Column, fixed: Mapping[str, float], rates: Mapping[tuple[str, str], float], states: Sequence[str], default: float = 0.075) -> Column:
    """The fixed fee of a kind of document, else valuation times the rate of state and court level, rounded as money; 0 for an unknown state."""
    rate = F.lit(Decimal(str(default)))
    for (s, l), r in rates.items():  # noqa: E741
        rate = F.when((state == s) & (level == l), F.lit(Decimal(str(r)))).otherwise(rate)
    fee = F.when(state.isin(*states), F.round(valuation.cast("decimal(18,2)") * rate, 2).cast("double")).otherwise(0.0)
    for name, amount in fixed.items():
        fee = F.when(kind == name, float(amount)).otherwise(fee)
    return fee

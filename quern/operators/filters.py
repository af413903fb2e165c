"""Predicates: search filters, a metadata filter language, LIKE patterns, exact citation bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_like(text: str, backslash: bool = True) -> str:
    """A text as a LIKE pattern that matches itself."""
    text = text.replace("\\", "\\\\") if backslash else text
    return text.replace("%", "\\%").replace("_", "\\_")


def contains_ci(column: Column | str, text: str) -> Column:
    """Case-insensitive substring match of a literal text."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike(f"%{escape_like(text)}%")


@dataclass(frozen=True)
class SearchFilters:
    """What a search is narrowed to; None or empty means anything."""

    court: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    case_type: str | None = None
    bench_type: str | None = None
    judge: str | None = None
    act: str | None = None
    disposal: str | None = None

    def merged(self, other: SearchFilters) -> SearchFilters:
        """Field by field this one's value where it is set, else the other's. Years count as set unless None."""
        pick = lambda a, b, name: (a if a is not None else b) if name.startswith("year") else (a or b)
        return SearchFilters(**{f.name: pick(getattr(self, f.name), getattr(other, f.name), f.name) for f in fields(self)})


def search_predicate(filters: SearchFilters) -> Column:
    """The filters as one condition over court, year, case_type, bench_type, judge[], acts[], disposal."""
    parts = [F.lit(True)]
    if filters.court:
        parts.append(F.lower("court").isin(*[c.lower() for c in filters.court]))
    if filters.year_from is not None:
        parts.append(F.col("year") >= filters.year_from)
    if filters.year_to is not None:
        parts.append(F.col("year") <= filters.year_to)
    for column, text in (("case_type", filters.case_type), ("disposal", filters.disposal)):
        if text:
            parts.append(contains_ci(column, text))
    if filters.bench_type:
        parts.append(F.col("bench_type") == filters.bench_type)
    if filters.judge:
        parts.append(F.exists("judge", lambda x: contains_ci(x.cast("string"), filters.judge)))
    if filters.act:
        parts.append(F.exists("acts", lambda x: F.lower(x) == filters.act.lower()))
    return reduce(lambda a, b: a & b, parts)


def metadata_predicate(wanted: Mapping[str, object], columns: Mapping[str, str]) -> Column:
    """A filter mapping as a condition. columns: the known keys and the columns they stand for.

    A bare value or ``$eq`` is equality; ``$ne``, ``$gte``, ``$lte`` (as integers);
    ``$in`` with one element asks whether an array has it, with more whether a
    scalar is among them. An unknown key or operator is an error.
    """
    parts = [F.lit(True)]
    for key, value in wanted.items():
        if key not in columns:
            raise KeyError(f"unknown filter: {key}")
        column = F.col(columns[key])
        for operator, operand in (value.items() if isinstance(value, Mapping) else [("$eq", value)]):
            if operator == "$eq":
                parts.append(column == F.lit(operand))
            elif operator == "$ne":
                parts.append(column != F.lit(operand))
            elif operator in ("$gte", "$lte"):
                number = column.cast("int")
                parts.append(number >= int(operand) if operator == "$gte" else number <= int(operand))
            elif operator == "$in":
                parts.append(F.array_contains(column, operand[0]) if len(operand) == 1 else column.isin(*operand))
            else:
                raise KeyError(f"unknown operator: {operator}")
    return reduce(lambda a, b: a & b, parts)


_QUOTED = str.maketrans({c: "\\" + c for c in r"\.[]{}()*+-?^$|/#&~ "})


def exact_mention(column: Column | str, text: str) -> Column:
    """Case-insensitive mention that stands between blanks, punctuation or the ends, so that "1" does not match "10"."""
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(rf"(?i)(^|\s){text.translate(_QUOTED)}($|\s|[,;.)\]])")


def has_all(column: str, values: Sequence) -> Column:
    """Whether an array has all values; false for null."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(v) for v in values]), F.col(column))) == 0, F.lit(False))


def joined_like(column: str, text: str) -> Column:
    """Case-insensitive substring of an array's elements joined by blanks."""
    return contains_ci(F.array_join(F.col(column).cast("array<string>"), " "), text)


def suggest(df: DataFrame, text: str, columns: Sequence[str], newest: str, limit: int = 10) -> DataFrame:
    """Rows with the text in one of the columns, newest first, unknown dates last."""
    found = reduce(lambda a, b: a | b, [contains_ci(c, text) for c in columns])
    return df.where(found).orderBy(F.desc_nulls_last(newest), columns[0]).limit(limit)


SORTABLE = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_last}


def sorted_by(df: DataFrame, column: str, direction: str, allowed: Sequence[str], tie: str) -> DataFrame:
    """Sort by an allowed column and direction; anything else is an error."""
    if column not in allowed or direction not in SORTABLE:
        raise ValueError(f"cannot sort by {column} {direction}")
    return df.orderBy(SORTABLE[direction](column), tie)


def between_times(column: str, start: str | None = None, end: str | None = None) -> Column:
    """start <= column < end; either may be open."""
    condition = F.lit(True)
    if start is not None:
        condition &= F.col(column) >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        condition &= F.col(column) < F.lit(end).cast("timestamp_ntz")
    return condition


def having_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; Spark broadcasts the ids if their measured size allows."""
    return df.join(ids.select(key), key, "left_semi")

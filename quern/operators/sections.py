"""Documents into sections, and sections into overlapping chunks that end at natural breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Section kinds and the headings that open them.
HEADINGS = [
    ("FACTS", r"(?:brief |relevant )?facts(?: of the case)?|factual background"),
    ("ISSUES", r"(?:points?|issues?|questions?) (?:for|arising|that arise)\b.*|issues"),
    ("ARGUMENTS", r"(?:arguments?|submissions?|contentions?)\b.*"),
    ("EVIDENCE", r"(?:evidence|testimony)\b.*"),
    ("ANALYSIS", r"(?:analysis|discussion|reasoning|findings?)\b.*"),
    ("RATIO", r"(?:ratio decidendi|ratio)\b.*"),
    ("ORDER", r"(?:order|conclusion|decision|result|disposition)\b.*"),
    ("DISSENT", r"(?:dissent(?:ing opinion)?)\b.*"),
]
_HEADING = re.compile("(?im)^[ \t]*(?:(?:[IVXLC]+|[0-9]+|[A-Z])[.):][ \t]*)?(?:" + "|".join(f"(?P<{k}>{p})" for k, p in HEADINGS) + r")[ \t]*:?[ \t]*$")
DENSE = {"RATIO", "ORDER", "ISSUES"}
#: (size, overlap) of chunks in ordinary and in dense sections.
SIZES = {False: (2000, 200), True: (1200, 300)}
LONGEST_HEADING = 100
_SENTENCE = re.compile(r"[.;?!][ \n]")
_ABBREVIATION = re.compile(r"\b(?:vs?|Dr|Mr|Mrs|Smt|Hon|No|Art|Sec|Vol|Ltd|Pvt|Ors|Anr|[A-Z])\.$")


def find_sections(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) that cover the text: a HEADER before the first heading; FULL where there is none.

    A heading too close after the last that was kept (50 characters for the same
    kind, 20 for another) is left out.
    """
    kept: list[tuple[int, str]] = []
    for m in _HEADING.finditer(text):
        if len(m[0]) > LONGEST_HEADING:
            continue
        at, kind = m.start(), m.lastgroup or "FULL"
        if kept and at - kept[-1][0] < (50 if kept[-1][1] == kind else 20):
            continue
        kept.append((at, kind))
    if not kept:
        return [("FULL", 0, len(text))] if text else []
    if kept[0][0] > 0:
        kept.insert(0, (0, "HEADER"))
    ends = [at for at, _ in kept[1:]] + [len(text)]
    return [(kind, at, end) for (at, kind), end in zip(kept, ends, strict=True) if text[at:end].strip()]


def _break_before(text: str, start: int, end: int) -> int:
    """The best place to end a piece of text[start:end]: paragraph, else sentence, else word."""
    if end >= len(text):
        return len(text)
    low = max(start + 500, end - 400)
    at = text.rfind("\n\n", low, end)
    if at >= 0:
        return at + 2
    for m in reversed(list(_SENTENCE.finditer(text, low, end))):
        if m[0][0] != "." or not _ABBREVIATION.search(text[max(0, m.start() - 10) : m.start() + 1]):
            return m.end()
    at = text.rfind(" ", low, end)
    return at + 1 if at >= 0 else end


def chunk(text: str) -> Iterator[tuple[str, int, int]]:
    """(section kind, start, end) of chunks. Together they cover the text, and consecutive ones of a section overlap."""
    for kind, begin, finish in find_sections(text):
        size, overlap = SIZES[kind in DENSE]
        body, at = text[begin:finish], 0
        while True:
            end = _break_before(body, at, min(at + size, len(body)))
            if body[at:end].strip():
                yield kind, begin + at, begin + end
            if end >= len(body):
                break
            ahead = at + max(end - at - overlap, 1)
            # Begin after the end of a sentence if one is near.
            snap = next((m.end() for m in _SENTENCE.finditer(body, ahead, ahead + 100)), None)
            at = min(snap, end) if snap is not None else ahead


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, section, start, end, body): one row a chunk of each whole text, positions in code points."""

    def pieces(source):
        import pyarrow as pa

        for batch in source:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, n, kind, a, b, t[a:b]) for n, (kind, a, b) in enumerate(chunk(t or ""))]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [batch.column(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "chunk", "section", "start", "end", "body"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(pieces, f"{key} {kind}, chunk int, section string, start long, end long, body string")


def section_map(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, body): the sections of each text; of several of one kind the last counts."""
    rows = chunk_documents(docs, key, text)
    joined = rows.groupBy(key, "section").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    both = joined.join(docs.select(key, text), key)
    return both.select(key, "section", F.substring(F.col(text), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("body"))


#: How the first page of a judgment begins.
COVER = r"(?im)^[ \t]*(?:IN THE (?:SUPREME|HIGH) COURT|REPORTABLE\b|NON-?REPORTABLE\b|(?:CIVIL|CRIMINAL) (?:APPELLATE|ORIGINAL) JURISDICTION)"


def strip_leading_bleed(text: Column | str, scan: int = 3000, least: int = 100) -> Column:
    """A text from its cover on, if that begins within ``scan`` characters and ``least`` or more stand before it (the end of another judgment)."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.regexp_instr(F.substring(text, 1, scan), F.lit(COVER))
    return F.when(at > least, text.substr(at, F.length(text))).otherwise(text)


def drop_repeated_lines(docs: DataFrame, key: str, text: str, least: int = 3, longest: int = 200) -> DataFrame:
    """(key, text): lines of under ``longest`` characters that stand ``least`` times or more in a text (page headers and footers) only where they stand first."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    bare = F.trim("line")
    counted = lines.where((bare != "") & (F.length("line") < longest)).groupBy(key, bare.alias("bare")).agg(F.count("*").alias("times"), F.min("n").alias("first")).where(F.col("times") >= least)
    marked = lines.withColumn("bare", bare).join(counted, [key, "bare"], "left")
    kept = marked.where(F.col("times").isNull() | (F.length("line") >= longest) | (F.col("n") == F.col("first")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias(text))


def merge_short(sections: DataFrame, key: str, order: str, text: str, least: int = 100) -> DataFrame:
    """(key, order, text): sections of under ``least`` characters as the end of the one before them; the first stays what it is."""
    own = Window.partitionBy(key).orderBy(order)
    opens = (F.length(text) >= least) | (F.row_number().over(own) == 1)
    grouped = sections.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "part").agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias(text)).drop("part")

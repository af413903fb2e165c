"""Checks and repairs of extracted records as Columns: fields against rules, against each other, and against what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import CITATIONS, extract_citations
from quern.functions.text import once as _once


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(text: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.when(F.trim(text) != "", F.trim(text))


def _first_of_each(items: Column) -> Column:
    """Entries in their order, of those that differ in case only the first; by sorting, so that long lists cost no square."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda e, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(e["k"]))

    numbered = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    in_order = F.sort_array(F.transform(_once(numbered, firsts), lambda e: F.struct(e["i"], e["x"])))
    return F.transform(in_order, lambda e: e["x"])


# Fields.


def plain_start(text) -> Column:
    """Without the punctuation and blanks that scanning puts before a title or a party."""
    return F.trim(F.regexp_replace(_col(text), r"^[.\s,;:]+", ""))


def year_in(year, first: int, last) -> Column:
    """The year, or null if it is outside."""
    return F.when(_col(year).between(F.lit(first), last if isinstance(last, Column) else F.lit(last)), _col(year))


def past_date(text, today) -> Column:
    """An ISO date up to ``today``; null for any other text."""
    day = F.try_to_date(_col(text), "yyyy-MM-dd")
    return F.when(day <= today, day)


def one_of(value, known: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """The value in small letters, by its usual name, if it is a known one."""
    low = F.lower(F.trim(_col(value)))
    for other, name in (aliases or {}).items():
        low = F.when(low == other, name).otherwise(low)
    return F.when(low.isin(*known), low)


def short_list(items, most: int) -> Column:
    """Trimmed entries, each once whatever its case, in their order, ``most`` at most; null for none."""
    kept = F.filter(F.transform(_col(items), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return _once(F.slice(_first_of_each(kept), 1, most), lambda cut: F.when(F.size(cut) > 0, cut))


def text_between(text, least: int, most: int) -> Column:
    """A text cut to ``most`` characters; null if it has fewer than ``least``."""
    return F.when(F.length(F.trim(_col(text))) >= least, F.substring(_col(text), 1, most))


def first_sentences(text, n: int) -> Column:
    """The first n sentences, as ``. `` ends them."""
    return F.when(F.size(F.split(_col(text), r"\. ")) > n, F.concat(F.substring_index(_col(text), ". ", n), F.lit("."))).otherwise(_col(text))


# Fields against each other.


def propositions_and_ratio(props: Column, ratio: Column, headnotes: Column) -> tuple[Column, Column]:
    """(propositions, ratio), each filled from the other: array<struct<text, novel>>, headnotes array<string>.

    A missing ratio comes from the first three propositions, those that are not
    novel first; missing propositions from the ratio, else from the headnotes.
    """
    known = F.coalesce(props, F.array().cast("array<struct<text:string,novel:boolean>>"))
    order = F.array_sort(F.transform(known, lambda p, i: F.struct(F.coalesce(p["novel"], F.lit(False)).alias("novel"), i.alias("i"), p["text"].alias("text"))))
    made = _filled(F.array_join(F.transform(F.slice(order, 1, 3), lambda p: p["text"]), " "))
    single = F.array(F.struct(F.trim(ratio).alias("text"), F.lit(False).alias("novel")))
    notes = F.transform(F.filter(F.coalesce(headnotes, F.array().cast("array<string>")), lambda h: F.trim(h) != ""), lambda h: F.struct(F.trim(h).alias("text"), F.lit(False).alias("novel")))
    has_ratio = F.coalesce(F.trim(ratio) != "", F.lit(False))
    return F.when(F.size(known) > 0, known).when(has_ratio, single).otherwise(notes), F.when(has_ratio, ratio).otherwise(made)


def first_sentence(text, most: int) -> Column:
    """The first sentence without its end, cut before a word to ``most`` characters."""
    one = F.trim(F.substring_index(_col(text), ". ", 1))
    cut = F.substring(one, 1, most)
    return F.when(F.length(one) > most, F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)).otherwise(one)


def describe(title, case_type, ratio, headnote, disposal) -> Column:
    """A description from what is known besides the title; null if nothing is."""
    title, case_type, ratio, headnote, disposal = (_filled(_col(c)) for c in (title, case_type, ratio, headnote, disposal))
    lead = F.concat(F.concat_ws(" — ", case_type, title), F.lit("."))
    held = F.coalesce(F.concat(F.lit("The court held that "), first_sentence(ratio, 200), F.lit(".")), F.concat(F.lit("Key issue: "), F.substring(headnote, 1, 150), F.lit(".")))
    end = F.concat(F.lit("The case was "), F.lower(disposal), F.lit("."))
    return F.when(title.isNotNull() & (held.isNotNull() | end.isNotNull()), F.substring(F.concat_ws(" ", lead, held, end), 1, 500))


#: How a text's end says what became of a matter.
OUTCOME = r"(?i)(?:the\s+)?(?:appeal|petition|writ(?:\s+petition)?|suit|case|special\s+leave\s+petition|criminal\s+appeal|civil\s+appeal)\s+(?:is|are|stands?|shall\s+stand)\s+(allowed|dismissed|partly\s+allowed|disposed\s+of|remanded|transferred|withdrawn)"


def outcome(disposal, case_type, ratio, text) -> Column:
    """A summary from the disposal and the ratio's first sentence, else the sentence in the last 3000 characters that tells it."""
    disposal, case_type, ratio = (_filled(_col(c)) for c in (disposal, case_type, ratio))
    said = F.concat(F.lit("The "), F.lower(F.coalesce(case_type, F.lit("case"))), F.lit(" was "), F.lower(disposal), F.lit("."))
    structured = F.substring(F.concat_ws(" ", said, F.concat(first_sentence(ratio, 150), F.lit("."))), 1, 300)
    # A stop is in no outcome, so the text is cut into sentences first and each is searched once.
    sentences = F.split(F.right(_col(text), F.lit(3000)), r"(?<=\.)", -1)
    found = _once(F.get(F.filter(sentences, lambda x: x.rlike(OUTCOME)), F.lit(0)), _filled)
    return F.when(disposal.isNotNull(), structured).otherwise(F.substring(found, 1, 200))


def fix_case_type(case_type, number) -> Column:
    """The case type, put right where the case's number says otherwise."""
    kind, said = _col(case_type), F.lower(_col(number))
    leave, writ = said.rlike(r"slp\s*\(\s*c\s*\)"), F.contains(said, F.lit("w.p.(c)"))
    fixed = F.when(F.contains(said, F.lit("civil appeal")) & (kind == "Criminal Appeal"), "Civil Appeal").when(F.contains(said, F.lit("criminal appeal")) & (kind == "Civil Appeal"), "Criminal Appeal")
    fixed = fixed.when((leave | writ) & (kind == "Criminal Appeal"), F.when(F.contains(said, F.lit("slp")), "Special Leave Petition").otherwise("Writ Petition"))
    return F.coalesce(fixed, kind)


#: The day from which the new codes hold.
NEW_CODES_FROM = "2024-07-01"


def primary_code(*dates) -> Column:
    """``old`` or ``new`` by the first date that can be read; ``new`` if none can."""
    forms = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy")
    day = F.coalesce(*[F.try_to_date(_col(c), f) for c in dates for f in forms])
    return F.when(day < F.lit(NEW_CODES_FROM).cast("date"), "old").otherwise("new")


def headnote_text(notes) -> Column:
    """The first headnote of a JSON list, object or plain text, 500 characters at most."""
    notes = _col(notes)
    first = F.coalesce(F.get_json_object(notes, "$[0]"), F.when(F.trim(notes).startswith("{"), notes))
    keys = [F.nullif(F.get_json_object(first, f"$.{k}"), F.lit("")) for k in ("proposition", "text", "headnote")]
    listed = F.trim(notes).rlike(r"^[\[{]")
    said = F.when(F.trim(first).startswith("{"), F.coalesce(*keys)).otherwise(first)
    return F.substring(F.coalesce(F.when(listed, said).otherwise(notes), F.lit("")), 1, 500)


def impact_label(weight) -> Column:
    return F.when(_col(weight) >= 0.3, "strong").when(_col(weight) >= 0.15, "moderate").otherwise("weak")


# Lists of citations and acts.

#: Words that begin a reference to a part of an act, and the letters of clipped words.
REFERENCE_WORDS = ("section", "sections", "sec", "article", "articles", "art", "order", "rule", "clause")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def is_case_citation(text) -> Column:
    """Whether an entry can be a case: 5 to 300 characters on one line, a capital, digit or bracket first, and not a number, a docket or a section."""
    def judged(t: Column) -> Column:
        words = F.split(t, r"\s+")
        number = lambda w, least, most: F.length(w).between(least, most) & (F.translate(w, "0123456789", "") == "")
        n = F.size(words)
        first, second, third = (F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in range(3))
        all_numbers = F.forall(words, lambda w: F.translate(w, "0123456789", "") == "")
        docket = (n == 3) & number(first, 2, 5) & (F.lower(second) == "of") & number(third, 4, 4)
        # A number with two letters behind it, and perhaps a number at these or after them.
        letters = F.rtrim(second, F.lit("0123456789"))
        clipped = number(first, 3, 4) & (F.length(letters) == 2) & (letters == F.initcap(letters)) & (F.translate(letters, LETTERS, "") == "") & ((n == 2) | (n == 3) & (letters == second) & number(third, 1, 99))
        section = (n > 1) & F.lower(F.rtrim(first, F.lit("."))).isin(*REFERENCE_WORDS)
        odd = F.length(F.translate(t, "_~`\n\r", "")) < F.length(t)
        return F.length(t).between(5, 300) & t.rlike(r"^[\p{Lu}\d(\[]") & ~(all_numbers | docket | clipped | section | odd)

    return F.coalesce(_once(F.trim(_col(text)), judged), F.lit(False))


def is_bare_reference(text) -> Column:
    """Whether a citation is nothing but a reporter's reference."""
    return F.trim(_col(text)).rlike(r"^(?:" + "|".join(f"(?:{p})" for _, p, _ in CITATIONS) + r")\.?$")


def classify_citations(entries) -> Column:
    """struct(named, bare): valid entries, each once whatever its case, sorted."""
    clean = F.filter(F.transform(_col(entries), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), is_case_citation)
    judged = F.transform(_first_of_each(clean), lambda x: F.struct(x.alias("x"), is_bare_reference(x).alias("bare")))
    listed = lambda j, bare: F.array_sort(F.transform(F.filter(j, lambda s: s["bare"] == bare), lambda s: s["x"]))
    return _once(judged, lambda j: F.struct(listed(j, False).alias("named"), listed(j, True).alias("bare")))


def graph_key(citation) -> Column:
    """A citation as graphs know it: small letters, no dots, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(_col(citation)), F.lit("."), F.lit("")), r"\s+", " "))


#: References inside other text: [Y] V REP P, (Y) V REP P, (Y) REP OnLine C P.
EMBEDDED = [r"\[\d{4}\]\s+\d+\s+[A-Z][A-Za-z.]*\s+\d+", r"\(\d{4}\)\s+\d+\s+[A-Z][A-Za-z.]*\s+\d+", r"\(?\d{4}\)?\s+[A-Z][A-Za-z]*\s+OnLine\s+\w+\s+\d+"]


def embedded_citations(text) -> Column:
    """The graph keys of references inside a longer citation."""
    marks = F.regexp_extract_all(_col(text), F.lit("(" + "|".join(EMBEDDED) + ")"), 1)
    return F.array_distinct(F.transform(marks, graph_key))


#: What an act's name ends in or is.
ACT_WORDS = r"(?i)\b(?:act|code|rules?|constitution|ordinance|regulations?|order|adhiniyam|sanhita|bye-?laws?)\b"
#: Words that stand in sentences, not in names of acts.
SENTENCE_WORDS = r"(?i)\b(?:is|was|were|has|have|had|shall|should|would|said|held|under|which|that|this|such|court|judge|appellant|respondent|petitioner)\b"


def is_act_name(name, codes: Sequence[str] = ()) -> Column:
    """Whether an entry can be the name of an act: a known code, or a capital first, a word for acts, and no sentence around it."""
    t = F.trim(_col(name))
    return F.coalesce(t.isin(*codes) | (F.length(t).between(6, 120) & t.rlike(r"^\p{Lu}") & t.rlike(ACT_WORDS) & ~t.rlike(SENTENCE_WORDS) & ~t.rlike(r"[_~`|{}]|\d{5,}")), F.lit(False))


def is_act_garbage(entry) -> Column:
    """Whether an entry of a list of acts is a piece of a sentence or of a citation."""
    t = F.trim(_col(entry))
    return F.coalesce(t.rlike(SENTENCE_WORDS) | t.rlike(r"(?i)\bv(?:s|ersus)?\.\s") | is_bare_reference(t) | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 3), F.lit(False))


def act_display(code, names: dict[str, tuple[str, int]]) -> Column:
    """``Full name, year`` of a code; the code itself where it is unknown."""
    out = _col(code)
    for short, (name, year) in names.items():
        out = F.when(F.upper(F.trim(_col(code))) == short.upper(), f"{name}, {year}").otherwise(out)
    return out


def citation_warning(text, section, sections: Sequence[str], least: int = 2) -> Column:
    """A warning for one of ``sections`` that has fewer citations than ``least``; null for others."""
    n = F.size(extract_citations(text))
    named = F.replace(F.lower(F.trim(_col(section))), F.lit(" "), F.lit("_"))
    return F.when(named.isin(*sections) & (n < least), F.concat(F.initcap(F.replace(_col(section), F.lit("_"), F.lit(" "))), F.lit(": only "), n.cast("string"), F.lit(" citation(s)")))


# Rows against known rows.


def plausible_members(rows: DataFrame, key: str, members: str, year: str, tenure: DataFrame) -> DataFrame:
    """rows(key, members array) without members of ``tenure``(name, first, last) who did not sit in the row's year; one year of grace, unknown names stay."""
    one = rows.select(key, year, F.posexplode(members).alias("place", "name"))
    known = one.join(tenure, "name", "left")
    kept = known.where(F.col(year).isNull() | F.col("first").isNull() | F.col(year).between(F.col("first"), F.col("last") + 1))
    listed = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias(members))
    return rows.select(key).join(listed, key, "left").select(key, F.coalesce(members, F.array().cast("array<string>")).alias(members))

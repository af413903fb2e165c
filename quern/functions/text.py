"""Text functions as Columns: normalising, masking, hashing, quality, citations, names, similarity.

All stay in the JVM, inside whole-stage code generation where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for a row, and not at each place that names it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def squash(text) -> Column:
    """Lower-cased, with runs of white space as one blank and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"^\s+|\s+$", ""), r"\s+", " ")


def content_hash(text) -> Column:
    return F.sha2(squash(text), 256)


# Identity numbers are masked in this order, so that a phone number is not taken for part of a longer one.
PII = [
    (r"\b(\d{4})\s(\d{4})\s(\d{4})\b", "[AADHAAR REDACTED]"),
    (r"(?:\+91[\s-]?|91[\s-]?|0)[6-9]\d{9}\b|\b[6-9]\d{9}\b", "[PHONE REDACTED]"),
    (r"\b\d{12}\b", "[AADHAAR REDACTED]"),
    (r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b", "[PAN REDACTED]"),
]


def mask_pii(text) -> Column:
    return _chain(_col(text), PII)


def strip_html(text) -> Column:
    return F.regexp_replace(_col(text), r"<[^>]+>", "")


def sanitize(text) -> Column:
    """Without tags and control characters, at most three line ends in a row, trimmed."""
    return F.regexp_replace(_chain(_col(text), [(r"<[^>]+>", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\n{4,}", "\n\n\n")]), r"^\s+|\s+$", "")


#: Our own choice of phrases by which a text tries to instruct a model.
INJECTION = r"(?i)ignore (all )?(previous|prior|above) instructions|disregard (all )?(previous|prior) (instructions|rules)|you are now|system prompt|<\|im_(start|end)\|>|\[/?INST\]"


def tries_injection(text) -> Column:
    return F.coalesce(_col(text).rlike(INJECTION), F.lit(False))


def clean_text(text) -> Column:
    """Without zero-width and control characters, lone page numbers, trailing blanks and runs of empty lines; dashes inside words as hyphens."""
    steps = [
        ("[\\u200B-\\u200F\\u2060\\uFEFF\\u00AD]", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"(?m)^[ \t]*(?:[Pp]age[ \t]+)?\d{1,4}(?:[ \t]+of[ \t]+\d{1,4})?[ \t]*$", ""),
        ("(\\w)[\\u2013\\u2014](?=\\w)", "$1-"), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    ]
    return _chain(_col(text), steps)


def letters_share(text) -> Column:
    text = _col(text)
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def count_present(text, words: Sequence[str]) -> Column:
    """How many of the words occur in the lower-cased text."""
    low = F.lower(_col(text))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def quality_tier(text, words: Sequence[str], pages: Column | None = None) -> Column:
    """high, medium or low, by length, known words, share of letters and characters a page."""
    text = _col(text)
    n, known = F.length(text), count_present(text, words)
    tier = F.when((n > 2000) & (known >= 3), "high").when((n > 500) & (known >= 1), "medium").otherwise("low")
    low = (n > 0) & (letters_share(text) < 0.4)
    if pages is not None:
        low = low | ((pages > 0) & (n > 0) & (n / pages < 100))
    return F.when(low, "low").otherwise(tier)


#: Phrases that signal a holding.
SIGNAL_PHRASES = [
    "held that", "we hold", "in our opinion", "it is well settled", "the ratio", "we are of the view", "the principle", "we approve", "we overrule", "we distinguish",
    "the question is answered", "the appeal is allowed", "the appeal is dismissed", "we are of the considered view", "in our considered opinion", "we accordingly hold",
]


def signal_density(text, phrases: Sequence[str] = SIGNAL_PHRASES) -> Column:
    """Phrases for 1000 characters, to two digits; 0 for an empty text."""
    text = _col(text)
    n = F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(phrases) + r")\b"))
    return F.when(F.length(text) > 0, F.round(n / F.length(text) * 1000, 2)).otherwise(0.0)


def paragraph_range(text) -> Column:
    """(least, most) number of numbered paragraphs; nulls where there are none."""
    marks = F.regexp_extract_all(_col(text), F.lit(r"(?m)^\s*(?:[(\[]|Para\.?\s*)?(\d{1,9})[.)\]]?\s"), 1)
    numbers = F.transform(marks, lambda x: x.cast("int"))
    return F.struct(F.array_min(numbers).alias("least"), F.array_max(numbers).alias("most"))


def control_characters(text) -> Column:
    return F.regexp_count(_col(text), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))


def is_garbled(text) -> Column:
    """Control characters, or more than two letters of the upper Latin-1 range."""
    return (control_characters(text) > 0) | (F.regexp_count(_col(text), F.lit("[\\u0080-\\u00A0\\u00C3\\u00C2]")) > 2)


def is_degenerate(text, least: int = 200) -> Column:
    """Too short, or a word or phrase of up to 40 characters five times in a row."""
    text = _col(text)
    return (F.length(F.trim(text)) < least) | text.rlike(r"(?s)(.{4,40}?)\1{4}")


def head_and_tail(text, head: int = 30_000, tail: int = 20_000, marker: str = "\n\n[...middle section truncated for length...]\n\n") -> Column:
    text = _col(text)
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def fix_title_ocr(title) -> Column:
    """Digits that stand for letters in small words of a title."""
    return _chain(_col(title), [(r"\b0F\b", "OF"), (r"\b1N\b", "IN"), (r"\bT0\b", "TO"), (r"\bAN0\b", "AND"), (r"\b0THERS\b", "OTHERS")])


def title_key(title) -> Column:
    """Lower-cased, ``v.``, ``vs`` and ``versus`` as ``v``; only a-z, digits and single blanks."""
    return F.trim(_chain(F.lower(_col(title)), [(r"\bv(?:s|ersus)?\b\.?", " v "), (r"[^a-z0-9\s]", ""), (r"\s+", " ")]))


#: How words of citations are written, by their capital letters without dots.
CITATION_WORDS = {"AIR": "AIR", "CRLJ": "CrLJ", "VS": "v.", "VERSUS": "v."}
#: Reporters whose year stands in round brackets.
ROUND_YEAR = ("SCC", "ITR", "taxmann.com")


def normalize_citation(citation) -> Column:
    """One spelling of a citation, put together from its words.

    Words are looked up without their dots; in citations with colons or slashes
    between their parts no blanks stand around these; the year of some reporters
    gets round brackets; a dot after the last number goes.
    """
    spelt = F.create_map(*[F.lit(x) for pair in CITATION_WORDS.items() for x in pair])

    def tight(said: Column) -> Column:
        return F.when(said.rlike(r"^\d{4} ?:"), F.regexp_replace(said, " ?: ?", ":")).when(said.rlike("^MANU ?/"), F.regexp_replace(said, " ?/ ?", "/")).otherwise(said)

    def line(said: Column) -> Column:
        words = F.transform(F.split(tight(said), " "), lambda w: F.coalesce(spelt[F.upper(F.replace(w, F.lit("."), F.lit("")))], w))
        return F.regexp_replace(F.array_join(words, " "), "SCC [Oo]n ?[Ll]ine", "SCC OnLine")

    def bracketed(line: Column) -> Column:
        year, volume, reporter = (F.regexp_extract(line, r"^\[(\d{4})\] (\d+) (\S+) ", n) for n in (1, 2, 3))
        rest = F.regexp_replace(line, r"^\[\d{4}\] \d+ \S+ ", "")
        round_year = F.concat(F.lit("("), year, F.lit(") "), F.concat_ws(" ", volume, reporter, rest))
        return F.when(F.startswith(line, F.lit("[")) & reporter.isin(*ROUND_YEAR), round_year).otherwise(line)

    said = once(F.trim(F.regexp_replace(_col(citation), r"\s+", " ")), line)
    return F.regexp_replace(once(said, bracketed), r"(\d) ?\.$", "$1")


#: Reporters and their patterns, in the order of priority, with confidence.
CITATIONS = [
    ("SCC_SUB", r"[(\[]\d{4}[)\]]\s+\d+\s+SCC\s+\(\w+(?:&\w+)?\)\s+\d+", 0.95),
    ("SCC", r"[(\[]\d{4}[)\]]\s*\d+\s*SCC\s+\d+", 0.95),
    ("SCC_ONLINE", r"\d{4}\s+SCC\s+[Oo]n\s*[Ll]ine\s+\w+\s+\d+", 0.95),
    ("AIR", r"A\.?I\.?R\.?\s+\d{4}\s+[A-Z]\w*\s+\d+", 0.95),
    ("NEUTRAL_SC", r"\d{4}:INSC:\d+", 0.95),
    ("NEUTRAL_HC", r"\d{4}:[A-Z]{2,4}HC:\d+", 0.95),
    ("INSC", r"\d{4}\s+INSC\s+\d+", 0.95),
    ("SCR", r"[(\[]\d{4}[)\]]\s+\d+\s+SCR\s+\d+", 0.95),
    ("SCR_BARE", r"\d{1,2}\s+S\.?C\.?R\.?\s+\d+", 0.9),
    ("CRLJ", r"\d{4}\s+Cr\.?L\.?J\.?\s+\d+", 0.9),
    ("SCALE", r"\(\d{4}\)\s+\d+\s+SCALE\s+\d+", 0.9),
    ("MANU", r"MANU/\w+/\d+/\d{4}", 0.9),
    ("JT", r"JT\s+\d{4}\s+\(\d+\)\s+\w+\s+\d+|\(\d{4}\)\s+\d+\s+JT\s+\(\w+\)\s+\d+", 0.9),
    ("HIGH_COURT", r"(?:\d{4}\s+|\(\d{4}\)\s+(?:\d+\s+)?)(?i:ILR|MLJ|KLT|BLR|GLR|ALJ|DLT|ALD|CLT|PLR|DRJ|KHC|RLW|LNIND|CDJ|BomLR|CalWN|WLC|JLJ|AIJEL|CriLJ|FLR|GujLR|MPLJ|OLR|WLR)\s+\d+", 0.85),
    ("LIVELAW", r"\d{4}\s+(?i:LiveLaw)\s+\(\w+\)\s+\d+", 0.9),
    ("ITR", r"[(\[]\d{4}[)\]]\s+\d+\s+ITR\s+\d+", 0.9),
    ("TAXMANN", r"[(\[]\d{4}[)\]]\s+\d+\s+(?i:taxmann\.com)\s+\d+", 0.9),
    ("COMP_CAS", r"[(\[]\d{4}[)\]]\s+\d+\s+(?i:Comp\s*Cas)\s+\d+", 0.9),
    ("LLJ", r"\d{4}\s+LLJ\s+\d+", 0.85),
    ("GENERIC", r"(?:\d{4}\s+|\(\d{4}\)\s+(?:\d+\s+)?)[A-Z][A-Za-z]{1,5}\s+\d+", 0.2),
]


#: Words that the last pattern takes for reporters and that are none.
NO_REPORTERS = """THE AND FOR NOT BUT WAS HAS HAD ARE HIS HER ITS ANY ALL MAY CAN ACT THAT THIS WITH FROM BEEN HAVE ALSO SUCH UPON INTO OVER SAID CASE COURT ORDER UNDER SHALL STATE INDIA WHICH WHERE
WOULD COULD SHOULD""".split()


def extract_citations(text) -> Column:
    """array<struct<reporter, citation, confidence>>: normalised, each once, as they come in the text; ten at most of unknown reporters.

    One pass over the text: at each place the first pattern that fits wins.
    """
    marks = F.regexp_extract_all(_col(text), F.lit(r"(?<![\w:])(?=[\d(\[AJM])(" + "|".join(f"(?:{p})" for _, p, _ in CITATIONS) + ")"), 1)
    which = lambda n, c: F.struct(F.lit(n).alias("reporter"), F.lit(c).alias("confidence"))

    def item(x: Column) -> Column:
        # Name and confidence come together, so that no pattern is tried twice.
        kind = reduce(lambda rest, p: F.when(x.rlike(p[1]), which(p[0], p[2])).otherwise(rest), reversed(CITATIONS[:-1]), which(CITATIONS[-1][0], CITATIONS[-1][2]))
        return once(kind, lambda k: F.struct(k["reporter"].alias("reporter"), normalize_citation(x).alias("citation"), k["confidence"].alias("confidence")))

    generic = CITATIONS[-1][0]
    word = lambda x: F.upper(F.regexp_extract(x, r"([A-Za-z]+)\s+\d+$", 1))
    unknown = lambda c: c["reporter"] == generic
    found = F.array_distinct(F.filter(F.transform(marks, item), lambda c: ~unknown(c) | ~word(c["citation"]).isin(*NO_REPORTERS)))

    def step(a: Column, x: Column) -> Column:
        more = F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["generic"] + unknown(x).cast("int")).alias("generic"))
        return F.when(unknown(x) & (a["generic"] >= 10), a).otherwise(more)

    def first_ten(f: Column) -> Column:
        few = F.size(F.filter(f, unknown)) <= 10
        return F.when(few, f).otherwise(F.aggregate(f, F.struct(F.slice(f, 1, 0).alias("kept"), F.lit(0).alias("generic")), step, lambda a: a["kept"]))

    return once(found, first_ten)


#: A word of a party's name, with the small words between two of them, and phrases after which a case is named.
PARTY = r"[A-Z][\w.']+(?:\s+(?:of|the|&|and))?"
NAMING = r"in|case\s+of|relied\s+on|referred\s+to"


def case_names(text) -> Column:
    """Distinct cases that a text names as ``X v. Y`` after a phrase like "relied on", in one spelling."""
    party = rf"{PARTY}(?:\s+{PARTY})*"
    marks = F.regexp_extract_all(_col(text), F.lit(rf"\b(?:{NAMING})\s+({party}\s+(?:v\.?s?\.?|versus)\s+{party})"), 1)
    return F.array_distinct(F.transform(marks, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), " (?:v\\.?s?\\.?|versus) ", " v. "), r"\.$", "")))


#: A section number, or a sign that two of them bound a range.
SECTION_TOKEN = r"\d+(?:-?[A-Z]{1,2}\b)?(?:\(\w+\))*|[-–]|\bto\b"


def expand_sections(text) -> Column:
    """'302, 304 and 307' or '302-304' as an array of section numbers; ranges of up to 20, wider ones as they are.

    Read as numbers and range signs, all else only separates: a sign joins the number after it to the last one.
    """
    tokens = F.regexp_extract_all(_col(text), F.lit(f"({SECTION_TOKEN})"), 1)
    number = lambda x: x.try_cast("int")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a["out"], -1)
        low, high = number(last), number(x)
        wide = (high > low) & (high - low <= 20)
        more = F.transform(F.sequence(F.when(wide, low + 1).otherwise(0), F.when(wide, high).otherwise(0)), lambda i: i.cast("string"))
        joined = F.when(wide, F.concat(a["out"], more)).otherwise(F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.concat(last, F.lit("-"), x))))
        grown = F.when(a["range"] & (F.size(a["out"]) > 0), joined).otherwise(F.concat(a["out"], F.array(x)))
        sign = x.isin("-", "–", "to")
        return F.struct(F.when(sign, a["out"]).otherwise(grown).alias("out"), sign.alias("range"))

    return once(tokens, lambda t: F.aggregate(t, F.struct(F.slice(t, 1, 0).alias("out"), F.lit(False).alias("range")), step, lambda a: a["out"]))


def extract_sections(text) -> Column:
    """Distinct section numbers that a text names, lists and ranges expanded."""
    marks = F.regexp_extract_all(_col(text), F.lit(r"(?i)\b(?:sections?|secs?\.?|u/s)\s+((?:\d+[A-Z]{0,2}(?:\(\d+\))?(?:\s*(?:,|/|-|to|and|&)\s*)?)+)"), 1)
    return F.array_distinct(F.flatten(F.transform(marks, lambda x: expand_sections(F.regexp_replace(x, r"(?i)(\s*(,|/|-|to|and|&)\s*)+$", "")))))


HONORIFICS = r"(?i)^(?:(?:hon'?ble|the|mr|mrs|ms|dr|justice|shri|smt|chief)\.?\s+)+"


def parse_judges(names) -> Column:
    """Names of a bench: split at the first separator present of | ; , without honorifics and J., each once."""
    names = _col(names)
    parts = F.when(F.contains(names, F.lit("|")), F.split(names, r"\|")).when(F.contains(names, F.lit(";")), F.split(names, ";")).otherwise(F.split(names, ","))
    bare = lambda x: F.trim(_chain(x, [(r"^\s+", ""), (HONORIFICS, ""), (r"(?i),?\s*\b(?:JJ?|CJI?)\.?\s*$", ""), (r"\b([A-Z])\.\s+(?=[A-Z]\.)", "$1."), (r"^[.,\s]+|[.,\s]+$", ""), (r"\s{2,}", " ")]))
    return F.array_distinct(F.filter(F.transform(parts, bare), lambda x: x != ""))


#: Words before a counsel's name, and words after it.
TITLES = ("mr", "mrs", "ms", "dr", "shri", "smt", "sh", "adv")
DESIGNATIONS = ("sr", "senior", "jr", "adv", "advs", "advocate", "advocates", "counsel", "asg", "sg", "aor")


def normalize_counsel(name) -> Column:
    """A counsel's name between the titles before it and the designations after it, word by word."""
    words = F.filter(F.split(F.replace(_col(name), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.replace(w, F.lit("."), F.lit(""))))
    n = F.size(words)
    kept_from = F.array_min(F.transform(F.filter(F.transform(bare, lambda w, i: F.struct((~w.isin(*TITLES)).alias("own"), i.alias("i"))), lambda x: x["own"]), lambda x: x["i"]))
    kept_to = F.array_max(F.transform(F.filter(F.transform(bare, lambda w, i: F.struct((~w.isin(*DESIGNATIONS)).alias("own"), i.alias("i"))), lambda x: x["own"]), lambda x: x["i"]))
    return F.when((n > 0) & (kept_to >= kept_from), F.array_join(F.slice(words, kept_from + 1, kept_to - kept_from + 1), " ")).otherwise("")


#: Treatments and the words that show them, in order.
TREATMENTS = [
    ("overruled", r"(?i)\b(?:overruled|overrule[sd]?\s+(?:by|in)|no\s+longer\s+good\s+law|per\s+incuriam|expressly\s+overruled|impliedly\s+overruled|stood\s+overruled)\b", 0.7),
    ("distinguished", r"(?i)\b(?:distinguished|distinguishable|distinguish(?:ed|ing)\s+(?:from|in|on))\b", 0.7),
    ("affirmed", r"(?i)\b(?:affirmed|upheld|approved|endorsed|confirmed\s+(?:by|in))\b", 0.5),
    ("not_followed", r"(?i)\b(?:(?:not|never|declined\s+to|refused\s+to)\s+follow(?:ed|ing)?|(?:not|never)\s+(?:been\s+)?followed)\b", 0.7),
    ("followed", r"(?i)\b(?:followed|applied|relied\s+upon|reiterated)\b", 0.5),
    ("explained", r"(?i)\b(?:explained|clarified|interpreted)\b", 0.5),
    ("doubted", r"(?i)\b(?:doubted|questioned|expressed\s+(?:doubt|reservation))\b", 0.5),
]


def treatments(text) -> Column:
    """array<struct<treatment, n, confidence>>; what says "not followed" is not counted as followed."""
    text = _col(text)
    patterns = {name: pattern for name, pattern, _ in TREATMENTS}
    rest = F.regexp_replace(text, patterns["not_followed"], " ")
    counts = [F.struct(F.lit(name).alias("treatment"), F.regexp_count(rest if name == "followed" else text, F.lit(pattern)).alias("n"), F.lit(sure).alias("confidence")) for name, pattern, sure in TREATMENTS]
    return F.filter(F.array(*counts), lambda x: x["n"] > 0)


def best_treatment(text, needle, width: int = 500) -> Column:
    """(treatment, confidence) that the text around the first place of ``needle`` shows best, of equal ones the first; null if it shows none."""
    text, needle = _col(text), _col(needle)
    at = F.when(F.length(needle) > 0, F.instr(text, needle)).otherwise(0)
    near = F.substring(text, F.greatest(F.lit(1), at - width), F.least(at - 1, F.lit(width)) + F.length(needle) + width)
    ranked = F.array_sort(F.transform(treatments(near), lambda x, i: F.struct((-x["confidence"]).alias("minus"), i.alias("i"), x["treatment"].alias("treatment"), x["confidence"].alias("confidence"))))
    best = F.get(ranked, F.lit(0))
    return F.when((at > 0) & best.isNotNull(), F.struct(best["treatment"].alias("treatment"), best["confidence"].alias("confidence")))


def is_overruling(text) -> Column:
    return F.coalesce(_col(text).rlike(TREATMENTS[0][1]), F.lit(False))


def trigrams(text) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def overlap(a: Column, b: Column, of: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(of), F.lit(1))


def trigram_similarity(a, b) -> Column:
    """Shared trigrams among all of both."""
    x, y = trigrams(a), trigrams(b)
    return overlap(x, y, F.array_union(x, y))


def thirds(text: Column) -> Column:
    """The different stretches of three characters of a text; a text is taken apart once, so long ones cost no square."""

    def joined(c: Column) -> Column:
        begins = F.when(F.size(c) >= 3, F.sequence(F.lit(0), F.size(c) - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(begins, lambda i: F.concat(c[i], c[i + 1], c[i + 2])))

    return once(F.filter(F.split(text, ""), lambda x: x != ""), joined)


def fuzzy_match(quote, passage, threshold: float = 0.85) -> Column:
    """Whether the passage has the quote, or at least the threshold of its words or of its character trigrams. Each part of the quote is looked up in the passage."""

    def judged(x: Column) -> Column:
        q, p = x["q"], x["p"]
        share = lambda parts, there: F.size(F.filter(parts, there)) / F.greatest(F.size(parts), F.lit(1))
        words = once(F.array_distinct(F.split(q, " ")), lambda w: share(w, lambda v: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" ")))))
        near = (words >= threshold) | (once(thirds(q), lambda t: share(t, lambda v: F.contains(p, v))) >= threshold)
        return F.when((q == "") | (p == ""), False).otherwise(F.contains(p, q) | near)

    return once(F.struct(squash(quote).alias("q"), squash(passage).alias("p")), judged)


def cache_key(*parts) -> Column:
    return F.sha2(F.to_json(F.struct(*[_col(p) for p in parts])), 256)


def safe_json(text, schema: str) -> Column:
    """JSON as it is, in a code fence, or the first object inside other text."""
    text = _col(text)
    return F.coalesce(F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), schema), F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema))


def parse_date(text) -> Column:
    """ISO, d/m/Y, d-m-Y and Y/m/d; null for anything else."""
    text = F.trim(_col(text))
    return F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")])

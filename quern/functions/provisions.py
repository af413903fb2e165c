"""Provisions of statutes that a text names: sections, articles, orders and rules, regulations, clauses, lists, ranges, "read with".

A reference is found as a phrase, then read token by token: a word for a kind of
provision changes the kind, a number is a provision of that kind, a sign between
two numbers a range, and the act at the phrase's end is that of all its numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import once

#: Short names of acts as they follow a number.
CODES = {
    "IPC": "Indian Penal Code", "I.P.C.": "Indian Penal Code", "CrPC": "Code of Criminal Procedure", "Cr.P.C.": "Code of Criminal Procedure", "CPC": "Code of Civil Procedure", "C.P.C.": "Code of Civil Procedure",
    "BNS": "Bharatiya Nyaya Sanhita", "BNSS": "Bharatiya Nagarik Suraksha Sanhita", "BSA": "Bharatiya Sakshya Adhiniyam", "Constitution": "Constitution of India", "Constitution of India": "Constitution of India",
}
#: How kinds are written, and what they are called.
KINDS = {"Section": r"sections?|secs?\.?|u/s|s\.", "Article": r"articles?|arts?\.?", "Order": r"orders?", "Rule": r"rules?|r\.", "Regulation": r"regulations?", "Clause": r"clauses?"}
#: A Roman number ends where its word does, and so does a kind that no dot ends: SECIÓN is no Section I.
NUMBER = r"(?:\d+[A-Z]{0,2}|[IVXL]+(?![\p{L}\p{M}\p{N}_]))(?:\(\w{1,4}\))*"
KIND = "(?i:" + "|".join(KINDS.values()) + r")(?:(?<=\.)|(?![\p{L}\p{M}]))"
SIGN = r"[-–]|\bto\b"
#: Where a reference may begin and its numbers end: not inside a word of any alphabet, nor in a mail address (r.23@example.com) or one of a network (s. 10.2.3.4).
START, END = r"(?<![\p{L}\p{M}\p{N}_@])", r"(?![\w.+-]*@|\d*(?:\.\d+){3})"
BETWEEN = rf"(?:\s*(?:,|/|&|\band\b|\bor\b|{SIGN})\s*)+"
READ_WITH = r"read\s+with|r/w"
#: Acts of the constitution's articles, of orders and rules where none is named, and the last article.
CONSTITUTION, PROCEDURE, LAST_ARTICLE = "Constitution of India", "Code of Civil Procedure", 395
#: The widest range that is written out.
WIDEST = 20


def _phrase(codes: Mapping[str, str]) -> str:
    """A pattern of a reference; its first group is the provisions, its second the act."""
    listed = rf"{NUMBER}{END}(?:(?:{BETWEEN}|\s+(?=(?i:rules?|r\.)\s))(?:{KIND}\s*)?{NUMBER}{END})*"
    known = "|".join(sorted((c.replace(".", r"\.") for c in codes), key=len, reverse=True))
    named = r"(?:[A-Z][A-Za-z]+\s+)(?:(?:of|and|the|for|[A-Z(][A-Za-z()]*)\s+){0,8}?(?:Act|Code|Rules|Regulations|Agreement|Order|Sanhita|Adhiniyam)\b"
    act = rf"(?:\s*,?\s*(?:of\s+)?(?:the\s+)?({named}|(?:{known})(?!\w)))?"
    return rf"({START}{KIND}\s*{listed}(?:\s*,?\s*(?i:{READ_WITH})\s+(?:{KIND}\s*)?{listed})*){act}"


def _kind(token: Column) -> Column:
    """The kind that a token names; null if it is none."""
    out = F.lit(None).cast("string")
    for name, pattern in KINDS.items():
        out = F.when(token.rlike(rf"^(?i:{pattern})$"), name).otherwise(out)
    return out


def _read(provisions: Column) -> Column:
    """The provisions of a phrase as array<struct<kind, number>>; a rule behind an order has the order's number with it."""
    pattern = rf"{KIND}|{NUMBER}|{SIGN}"
    tokens = F.regexp_extract_all(provisions, F.lit(f"({pattern})"), 1)
    state = F.struct(F.array().cast("array<struct<kind:string,number:string>>").alias("out"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("order"), F.lit(False).alias("range"))

    def step(a: Column, x: Column) -> Column:
        return once(_kind(x), lambda kind: following(a, x, kind))

    def following(a: Column, x: Column, kind: Column) -> Column:
        said = F.struct(a["out"].alias("out"), kind.alias("kind"), F.when(kind == "Rule", a["order"]).alias("order"), F.lit(False).alias("range"))
        sign = F.struct(a["out"].alias("out"), a["kind"].alias("kind"), a["order"].alias("order"), (F.size(a["out"]) > 0).alias("range"))
        return F.when(kind.isNotNull(), said).when(x.rlike(rf"^(?:{SIGN})$"), sign).otherwise(numbered(a, x))

    def numbered(a: Column, x: Column) -> Column:
        last = F.get(a["out"], F.size(a["out"]) - 1)["number"]
        low, high = last.try_cast("int"), x.try_cast("int")
        wide = a["range"] & (high > low) & (high - low <= WIDEST)
        one = F.array(F.struct(a["kind"].alias("kind"), x.alias("number")))
        inside = F.transform(F.sequence(F.when(wide, low + 1).otherwise(F.lit(0)), F.when(wide, high).otherwise(F.lit(0))), lambda i: F.struct(a["kind"].alias("kind"), i.cast("string").alias("number")))
        # An order is a provision only with its rule; a rule without an order stays a rule.
        rule = F.array(F.struct(F.lit("Rule").alias("kind"), F.concat(a["order"], F.lit("/"), x).alias("number")))
        more = F.when(a["kind"] == "Order", F.slice(a["out"], 1, 0)).when((a["kind"] == "Rule") & a["order"].isNotNull(), rule).when(F.coalesce(wide, F.lit(False)), inside).otherwise(one)
        return F.struct(F.concat(a["out"], more).alias("out"), a["kind"].alias("kind"), F.when(a["kind"] == "Order", x).otherwise(a["order"]).alias("order"), F.lit(False).alias("range"))

    return once(tokens, lambda t: F.aggregate(t, state, step, lambda a: a["out"]))


def statute_references(text: Column | str, codes: Mapping[str, str] = CODES) -> Column:
    """array<struct<act, provision>> of the provisions that a text names, each once, in their order.

    ``act`` is the act behind the phrase, by its full name where a short one is
    known; articles up to 395 without an act are the constitution's, orders with
    rules without one the code of civil procedure's; null for others. Ranges of up
    to 20 numbers are written out, of wider ones the ends. Null and empty texts
    have none.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    pattern = _phrase(codes)
    phrases = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("a"))
    full = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])

    def listed(phrase: Column) -> Column:
        act = F.regexp_replace(F.trim(phrase["a"]), r"\s+", " ")
        named = F.when(act != "", F.coalesce(full[act], act))

        def one(x: Column) -> Column:
            number = F.regexp_extract(x["number"], r"^(\d+)", 1).try_cast("int")
            bare = F.when((x["kind"] == "Article") & number.between(1, LAST_ARTICLE), CONSTITUTION).when((x["kind"] == "Rule") & F.contains(x["number"], F.lit("/")), PROCEDURE)
            rule = F.concat(F.lit("Order "), F.substring_index(x["number"], "/", 1), F.lit(" Rule "), F.substring_index(x["number"], "/", -1))
            said = F.when((x["kind"] == "Rule") & F.contains(x["number"], F.lit("/")), rule).otherwise(F.concat_ws(" ", x["kind"], x["number"]))
            return F.struct(F.coalesce(named, bare).alias("act"), said.alias("provision"))

        return F.transform(_read(phrase["p"]), one)

    return F.array_distinct(F.flatten(F.transform(phrases, listed)))

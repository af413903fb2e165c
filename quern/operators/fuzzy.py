"""Fuzzy joins without cross joins: keys by equality, containment or shared words; quotes found in passages with their place.

Every round turns nearness into equality of something that near rows must share: a
contained text shares its rarest character gram, word sets with enough words in
common share one of their rarest words, and a quote with few changed words leaves
one of its parts as it was. What this proposes is then verified exactly, so the
joins lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import squash
from quern.storage import settle

#: Words before a citation that do not belong to it.
LEADS = r"^(?:see|cf\.?|per|in)\s+"
#: Characters of a gram, and most words of one.
CHARS, WORDS = 3, 8
#: Bits of the filter of quotes' stretches, 16 MB whatever the quotes; those that share a bit only let through more.
FILTER_BITS = 27
#: Words of texts that a task hashes at a time.
SLICE = 1 << 20


def citation_key(text: Column | str) -> Column:
    """A citation as it is compared: small letters, single blanks, no leading ``see``, ``cf.``, ``per`` or ``in``."""
    return F.regexp_replace(squash(text), LEADS, "")


def _grams(text: Column) -> Column:
    """All different grams of up to CHARS characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, CHARS + 1)])))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): the texts ``t`` of ``inner`` that a text ``t`` of ``outer`` has inside; both without repeats or empty texts."""
    held = outer.select("t", F.explode(_grams(F.col("t"))).alias("gram"))
    asked = inner.select("t", F.explode(_grams(F.col("t"))).alias("gram")).where(F.char_length("gram") == F.least(F.char_length("t"), F.lit(CHARS)))
    known = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no outer text has rules its text out: only texts all of whose grams are known go on.
    rare = asked.join(known, "gram", "left").groupBy("t").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("known"))
    pairs = rare.where("known").select(F.col("t").alias("inner"), "gram").join(held.withColumnRenamed("t", "outer"), "gram")
    return pairs.where(F.contains("outer", "inner")).select("inner", "outer")


def _sorted_words(texts: DataFrame, frequency: DataFrame) -> DataFrame:
    """(t, words): the different words of each text, the rarest first."""
    words = texts.select("t", F.explode(_words(F.col("t"))).alias("word")).join(frequency, "word")
    return words.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def _overlapping(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(left, right, common, most): texts ``t`` that share ``percent`` % or more of the words of the one with more, of left's texts those with two words or more.

    Two such texts share one of the rarest n - ceil(percent n / 100) + 1 words of each (prefix filter).
    """
    frequency = left.unionByName(right).select(F.explode(_words(F.col("t"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = settle(frequency, "word-counts")
    prefix = lambda c: F.slice(c, 1, F.size(c) - F.floor((percent * F.size(c) + 99) / 100).cast("int") + 1)
    a = _sorted_words(left, frequency).where(F.size("words") >= 2).select(F.col("t").alias("left"), F.col("words").alias("a"), F.explode(prefix(F.col("words"))).alias("word"))
    b = _sorted_words(right, frequency).select(F.col("t").alias("right"), F.col("words").alias("b"), F.explode(prefix(F.col("words"))).alias("word"))
    sizes = (100 * F.least(F.size("a"), F.size("b")) >= percent * F.greatest(F.size("a"), F.size("b")))
    # A pair may share several rare words: it counts at the first of both, which needs no shuffle to find.
    first = F.array_intersect(prefix(F.col("a")), prefix(F.col("b")))[0] == F.col("word")
    pairs = a.join(b, "word").where(sizes & first)
    common, most = F.size(F.array_intersect("a", "b")), F.greatest(F.size("a"), F.size("b"))
    return pairs.select("left", "right", common.alias("common"), most.alias("most")).where(100 * F.col("common") >= percent * F.col("most"))


def fuzzy_join(asked: DataFrame, keys: DataFrame, text: str = "text", key: str = "key", id_col: str = "id", *, percent: int = 60) -> DataFrame:
    """``asked`` with ``target`` and ``tier``: the id of the key that its text stands for, by the first round that finds one.

    1 the key as it is; 2 the same ``citation_key``; 3 one inside the other, the
    longest key; 4 the largest share of common words (of the larger number of
    words), ``percent`` or more, for texts of two words or more. 0 and null where
    none does. Of keys that are alike the largest id stands for them, of equally good
    ones in rounds 3 and 4 the smallest id is taken. Null and blank texts and keys
    match nothing. Texts that repeat are looked up once.
    """
    texts = settle(asked.where(F.trim(text) != "").select(F.col(text).alias("raw"), citation_key(text).alias("t")).distinct().where("t != ''"), "asked-texts")
    names = keys.where(F.trim(key) != "").select(F.col(key).alias("raw"), citation_key(key).alias("t"), F.col(id_col).alias("id")).where("t != ''")
    names = settle(names, "key-names")
    exact = texts.join(names.groupBy("raw").agg(F.max("id").alias("target")), "raw").select("raw", "target", F.lit(1).alias("tier"))
    by_key = settle(names.groupBy("t").agg(F.max("id").alias("id")), "keys")
    rest = texts.join(exact, "raw", "left_anti")
    alike = rest.join(by_key, "t").select("raw", F.col("id").alias("target"), F.lit(2).alias("tier"))
    rest = settle(rest.join(by_key, "t", "left_anti"), "third-round")
    left, right = rest.select("t").distinct(), by_key.select("t")
    both = _contained(left, right).select(F.col("inner").alias("t"), F.col("outer").alias("k")).unionByName(_contained(right, left).select(F.col("outer").alias("t"), F.col("inner").alias("k")))
    longest = both.join(by_key.withColumnRenamed("t", "k"), "k").groupBy("t").agg(F.max_by("id", F.struct(F.char_length("k"), -F.col("id"))).alias("target"))
    longest = settle(longest, "contained")
    inside = rest.join(longest, "t").select("raw", "target", F.lit(3).alias("tier"))
    rest = rest.join(longest, "t", "left_anti")
    shared = _overlapping(rest.select("t").distinct(), right, percent).join(by_key.withColumnRenamed("t", "right"), "right")
    best = shared.groupBy("left").agg(F.max_by("id", F.struct(F.col("common") / F.col("most"), -F.col("id"))).alias("target"))
    near = rest.join(best, rest["t"] == best["left"]).select("raw", "target", F.lit(4).alias("tier"))
    found = exact.unionByName(alike).unionByName(inside).unionByName(near).withColumnRenamed("raw", "quern_raw")
    return asked.join(found, F.col(text) == F.col("quern_raw"), "left").drop("quern_raw").withColumn("tier", F.coalesce("tier", F.lit(0)))


# Quotes.


def _split(text: Column | str) -> Column:
    return F.split(squash(text), " ")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams_of(hashes: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, grams) for each n of the ascending ``lengths``: of all stretches of n words that begin at 0, 1, .. a hash, from the words' hashes."""
    grams, size = np.zeros(len(hashes), np.uint64), 0
    for n in lengths:
        while size < n:
            grams = (((grams << np.uint64(23)) | (grams >> np.uint64(41))) ^ np.roll(hashes, -size)) * np.uint64(0x9E3779B97F4A7C15)
            size += 1
        yield n, grams ^ (grams >> np.uint64(29))


def _sliced(batch, lists: int):
    """The batch in parts whose lists have SLICE values or so; a longer one is a part of its own."""
    held = np.cumsum(np.diff(batch.column(lists).offsets.to_numpy())) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of lists of longs: all values, the row of each, and its place there."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _quote_grams(quotes: DataFrame) -> DataFrame:
    """(quote, n, most, part, length, at, gram): of each part of a quote its stretches of WORDS words, or the part if it has fewer."""

    def batches(source):
        import pyarrow as pa

        for batch in (part for whole in source for part in _sliced(whole, 3)):
            hashes, row, at = _flat(batch.column(3))
            n, cuts = (batch.column(c).to_numpy().astype(np.int64)[row] for c in (1, 2))
            part = ((at + 1) * (cuts + 1) - 1) // np.maximum(n, 1)
            begins, ends = -(-part * n // (cuts + 1)), -(-(part + 1) * n // (cuts + 1))
            length = np.minimum(ends - begins, WORDS)
            for size, grams in _grams_of(hashes, np.unique(length).tolist()):
                own = np.flatnonzero((length == size) & (at + size <= ends))
                yield pa.record_batch([batch.column(0).take(pa.array(row[own])), *(pa.array(x[own].astype(np.int32)) for x in (n, cuts, part, length, at)), pa.array(grams[own].view(np.int64))], names=["quote", "n", "most", "part", "length", "at", "gram"])

    kind = quotes.schema["quote"].dataType.simpleString()
    return quotes.select("quote", "n", "most", _hashed(F.col("words"))).mapInArrow(batches, f"quote {kind}, n int, most int, part int, length int, at int, gram long")


def _passage_grams(passages: DataFrame, grams: DataFrame) -> DataFrame:
    """(passage, gram, pos): the stretches of passages(passage, words) that may be among ``grams``, by a filter of bits.

    The filter keeps what no quote has out of the shuffle. It is a table of bits by
    hash, so what it lets through still has to meet its gram in a join.
    """
    spark = passages.sparkSession
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # WORDS at most
    spot = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    longs = grams.groupBy(F.shiftrightunsigned(spot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[longs.column("i").to_numpy()] = longs.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)

    def batches(source):
        import pyarrow as pa

        own = sent.value
        for batch in (part for whole in source for part in _sliced(whole, 1)):
            hashes, row, pos = _flat(batch.column(1))
            left = np.bincount(row, minlength=batch.num_rows)[row] - pos
            for size, found in _grams_of(hashes, lengths):
                at = found >> np.uint64(64 - FILTER_BITS)
                kept = np.flatnonzero((left >= size) & ((own[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool))
                yield pa.record_batch([batch.column(0).take(pa.array(row[kept])), pa.array(found[kept].view(np.int64)), pa.array(pos[kept].astype(np.int32))], names=["passage", "gram", "pos"])

    return passages.select("passage", _hashed(F.col("words"))).mapInArrow(batches, f"passage {passages.schema['passage'].dataType.simpleString()}, gram long, pos int")


def nearest_end(quote: list[str], window: list[str]) -> tuple[int, int]:
    """(changes, end): the fewest changes that make a stretch of ``window`` the quote, and where the first such stretch ends.

    A column of ``align`` at a time, as bits that tell where it rises and falls (Myers).
    """
    has: dict[str, int] = {}
    for i, word in enumerate(quote):
        has[word] = has.get(word, 0) | 1 << i
    top = len(quote) - 1
    every = (1 << len(quote)) - 1
    rises, falls, changes = every, 0, len(quote)
    best = (changes, 0)
    for j, word in enumerate(window, 1):
        same = has.get(word, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up, low = falls | (every & ~(across | rises)), rises & across
        changes += (up >> top & 1) - (low >> top & 1)
        if changes < best[0]:
            best = (changes, j)
        up, low = up << 1 & every, low << 1 & every
        rises, falls = low | (every & ~(down | up)), up & down
    return best


def align(quote: list[str], window: list[str], most: int) -> tuple[int, int, int] | None:
    """(changes, start, end) of the stretch of ``window`` that takes the fewest words changed, left out or put in to become ``quote``.

    Of equally good stretches the first to end, then the longest; None if it takes more than ``most`` changes.
    """
    above = [(0, -j) for j in range(len(window) + 1)]  # changes, and minus the start
    for i, word in enumerate(quote, 1):
        row = [(i, 0)]
        for j, other in enumerate(window, 1):
            (a, s), (b, t), (c, u) = above[j - 1], above[j], row[-1]
            row.append(min((a + (word != other), s), (b + 1, t), (c + 1, u), key=lambda x: (x[0], -x[1])))
        above = row
    changes, end = min((x[0], j) for j, x in enumerate(above))
    return (changes, -above[end][1], end) if changes <= most else None


def find_quotes(quotes: DataFrame, passages: DataFrame, quote_id: str = "quote", passage_id: str = "passage", text: str = "text", *, percent: int = 15) -> DataFrame:
    """(quote, passage, changes, start, end, stretch): where passages have a quote with at most ``percent`` % of its words changed.

    Words are what white space separates, in small letters. ``changes`` is the
    least number of words changed, left out or put in, ``start`` and ``end`` the words of
    the passage that it takes them for (the end not included), ``stretch`` these
    words. One row for each pair of a quote and a passage that has it, the place
    with the fewest changes, of these the first. Null and blank texts match nothing; ids are
    unique and not null. Quotes of n words may have e = percent n / 100 changes: cut
    into e + 1 parts, one part is there unchanged, so each part, or its rarest stretch
    of WORDS words if it has more, leads to every place, in whole passages. A task
    verifies places one by one, each within the quote's length and its changes.
    """
    q = quotes.where(F.trim(text) != "").select(F.col(quote_id).alias("quote"), _split(text).alias("words"))
    q = q.where("words[0] != ''").withColumn("n", F.size("words")).withColumn("most", F.floor(F.col("n") * percent / 100).cast("int"))
    q = settle(q, "quotes")
    grams = settle(_quote_grams(q), "quote-grams")
    whole = passages.where(F.trim(text) != "").select(F.col(passage_id).alias("passage"), F.col(text).alias("text"))
    split = lambda rows: rows.select("passage", _split("text").alias("words"))
    there = settle(_passage_grams(split(whole), grams), "passage-grams")
    counted = there.groupBy("gram").agg(F.count("*").alias("df"))
    seeds = grams.join(counted, "gram").groupBy("quote", "n", "most", "part").agg(F.min_by(F.struct("gram", "at"), F.struct("df", "at")).alias("s"))
    seeds = settle(seeds.select("quote", "n", "most", "s.gram", "s.at"), "seeds")
    start = F.greatest(F.col("pos") - F.col("at") - F.col("most"), F.lit(0))
    places = there.join(seeds, "gram").select("passage", "quote", start.alias("from"), (F.col("pos") - F.col("at") + F.col("n") + F.col("most")).alias("to")).distinct()
    places = settle(places, "places")
    # Only passages with a place are cut into words again.
    held = split(whole.join(places.select("passage").distinct(), "passage", "left_semi"))
    asked = places.join(held, "passage").select("passage", "quote", "from", F.expr("slice(words, from + 1, to - from)").alias("window"))
    asked = asked.join(q.select("quote", "words", "most"), "quote")

    def verified(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for quote, passage, at, window, words, most in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                changes, end = nearest_end(words, window)
                if changes <= most:
                    # The stretch ends there, so no more than the quote's length and its changes before it can belong to it.
                    cut = max(0, end - len(words) - changes)
                    begin = cut + align(words, window[cut:end], most)[1] if changes else cut
                    out.append((quote, passage, changes, at + begin, at + end, " ".join(window[begin:end])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (batch.schema.types[0], batch.schema.types[1], pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["quote", "passage", "changes", "start", "end", "stretch"])

    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("quote", "passage")}
    found = asked.select("quote", "passage", "from", "window", "words", "most").mapInArrow(verified, f"quote {kinds['quote']}, passage {kinds['passage']}, changes int, start int, end int, stretch string")
    best = found.groupBy("quote", "passage").agg(F.min(F.struct("changes", "end", "start", "stretch")).alias("b"))
    return best.select("quote", "passage", "b.changes", "b.start", "b.end", "b.stretch")

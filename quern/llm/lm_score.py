"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Tokens are the white-space-separated words of a text, A-Z lower-cased, then one
end token, which is also what the first word of a text follows.

1. Texts are cut into tokens once and written as blocks of about a million
   tokens of documents of one part (main, held out, not for training).
2. Words, then pairs of neighbouring words, are counted over all blocks, and each
   block gets the totals of its own (see exchange.py).
3. Expectation-maximisation on the held-out documents finds mixture weights for
   each bucket of context counts, the main part giving the estimates.
4. Each block scores its documents by the totals of both parts.

Every word and every pair keeps its own count, whatever their numbers. Words and
pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size, column_bytes, materialise
from quern.llm.exchange import HELD, MAIN, exchange, gather

END = b" "  # no word has white space
OTHER = 2  # after MAIN and HELD
SEED = 42
#: Words a worker keeps the hashes of.
REMEMBERED = 400_000
#: Bytes of text that are cut into tokens at a time, and tokens at which a block is closed; a longer text is a block of its own.
READ_BYTES, BLOCK_TOKENS = 4 << 20, 1 << 20
#: Different keys of blocks that one slot adds up.
SLOT_KEYS = 1 << 20
#: Resolution of log-probabilities in the histogram of held-out events.
STEP = 0.125
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, limit: int):
    """A long text in pieces of about ``limit`` bytes, cut at white space."""
    at = 0
    while len(text) - at > limit:
        cut = BLANK.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class _Words:
    """Numbers for words, local to a worker, with their hashes."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, split: list[list[bytes]]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        new = list(set().union(*split).difference(self.numbers))
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.hashes = np.concatenate((self.hashes, np.array([xxh64_intdigest(w, SEED) for w in new], np.uint64)))
        return np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int32, sum(map(len, split)))

    def hashed(self, texts: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The token hashes' numbers of some texts and each text's number of tokens."""
        if sum(map(len, texts)) <= 2 * limit:
            split = [t.lower().split() for t in texts]  # of bytes: A-Z and ASCII white space only
            for words in split:
                words.append(END)
            return self(split), np.fromiter(map(len, split), np.int32, len(split))
        numbers, lengths = [], []
        for text in texts:
            own = [self([piece.lower().split()]) for piece in _pieces(text, limit)]
            own.append(self([[END]]))
            numbers += own
            lengths.append(sum(map(len, own)))
        return np.concatenate(numbers), np.array(lengths, np.int32)


def tokenised(docs: DataFrame, part: Column, id_col: str, text_col: str, block_tokens: int = BLOCK_TOKENS, read_bytes: int = READ_BYTES) -> DataFrame:
    """Blocks of documents of one part.

    ids, lengths (int32 tokens a document), words (sorted uint64 hashes of the
    block's different words), counts (int32 of each), tokens (int32 places in words).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.cast("int").alias("part"))

    def batches(source):
        import pyarrow as pa
        from pyspark import TaskContext

        words, block = _Words(), TaskContext.get().partitionId() << 32
        held: dict[int, list] = {MAIN: [], HELD: [], OTHER: []}

        def close(kind: int):
            nonlocal block
            ids, lengths, numbers = zip(*held[kind], strict=True)
            held[kind] = []
            numbers = np.concatenate(numbers)
            counts = np.bincount(numbers, minlength=len(words.hashes))
            own = np.flatnonzero(counts)
            own = own[np.argsort(words.hashes[own])]
            place = np.zeros(len(words.hashes), np.int32)
            place[own] = np.arange(len(own))
            ids = pa.concat_arrays(ids)
            columns = [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(lengths), words.hashes[own], counts[own].astype(np.int32), place[numbers])]
            block += 1
            return pa.record_batch(columns, names=["block", "part", "ids", "lengths", "words", "counts", "tokens"])

        for batch in source:
            texts, parts = column_bytes(batch, "text"), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in chunks_by_size(texts, read_bytes):
                for kind in held:
                    at = (np.flatnonzero(parts[a:b] == kind) + a).tolist()
                    if at:
                        numbers, lengths = words.hashed([texts[i] for i in at], read_bytes)
                        held[kind].append((batch.column(0).take(pa.array(at)), lengths, numbers))
                        if sum(len(x[2]) for x in held[kind]) >= block_tokens:
                            yield close(kind)
                if len(words.numbers) > REMEMBERED:
                    yield from (close(kind) for kind in held if held[kind])
                    words = _Words()
        yield from (close(kind) for kind in held if held[kind])

    return rows.mapInArrow(batches, f"block long, part int, ids array<{rows.schema['id'].dataType.simpleString()}>, lengths binary, words binary, counts binary, tokens binary")


def pair_hashes(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of (token before it, token), and the place in ``words`` of the one before it."""
    from xxhash import xxh64_intdigest

    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(words, np.uint64(xxh64_intdigest(END, SEED)))
    x = words[before] * np.uint64(0x9E3779B97F4A7C15) + words[tokens]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31)), before


def _block_pairs(batch, i: int) -> tuple[np.ndarray, np.ndarray]:
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    return np.unique(pair_hashes(get("words", "<u8"), get("tokens", "<i4"), get("lengths", "<i4"))[0], return_counts=True)


def _block_words(batch, i: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch.column("words")[i].as_py(), "<u8"), np.frombuffer(batch.column("counts")[i].as_py(), "<i4")


def _with_replies(blocks: DataFrame, words: DataFrame, pairs: DataFrame, of, schema: str) -> DataFrame:
    """Hands ``of`` each block with the totals of its words and pairs.

    ``of`` gets (ids, lengths, words (main, held), the words' places of tokens and
    of those before them, pairs (main, held) of each token) and returns columns of ``schema``.
    """

    def by_token(block, word, pair):
        lengths, hashes, tokens = (np.frombuffer(block[x].as_py(), kind) for x, kind in (("lengths", "<i4"), ("words", "<u8"), ("tokens", "<i4")))
        keys, before = pair_hashes(hashes, tokens, lengths)
        place = np.unique(keys, return_inverse=True)[1]
        return of(block["ids"].values, lengths, word, tokens, before, [x[place] for x in pair])

    return gather(blocks, ["ids", "lengths", "words", "tokens"], [words, pairs], by_token, schema)


def bucket_of(counts):
    """Contexts are pooled by the binary logarithm of their count."""
    return np.floor(np.log2(np.asarray(counts, np.float64) + 1)).astype(np.int64)


def estimates(pair, context, own, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood bigram and unigram estimates; 0 where nothing was seen."""
    return np.divide(pair, context, out=np.zeros(len(pair)), where=np.asarray(context) > 0), np.asarray(own) / max(1, tokens)


def learn_weights(histogram: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM for the mixture weights of each bucket: (bigram, unigram, uniform).

    histogram: rows bucket, n, p2, p1, p0 of held-out events. A bucket without
    events takes the weights of the next one below that has some, or else (0.6, 0.3,
    0.1); bucket 0, of contexts never seen, (0, 0.9, 0.1).
    """
    weights = np.tile([0.6, 0.3, 0.1], (64, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b in range(64):
        own = histogram[histogram[:, 0] == b]
        if not len(own):
            weights[b] = weights[b - 1] if b > 1 else weights[b]
            continue
        n, p = own[:, 1], own[:, 2:]
        w = weights[b]
        for _ in range(rounds):
            mixed = p * w
            share = mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        # The uniform part never goes, so no text has probability 0.
        weights[b] = (w + [0.0, 0.0, 1e-6]) / (1 + 1e-6)
    return weights


def _held_out_events(blocks: DataFrame, words: DataFrame, pairs: DataFrame, main_tokens: int, distinct: int) -> np.ndarray:
    """Held-out tokens by bucket and log-probabilities to the nearest STEP: as many rows as steps at most, whatever the corpus."""

    def binned(ids, lengths, word, tokens, before, pair):
        p2, p1 = estimates(pair[0], word[0][before], word[0][tokens], main_tokens)
        with np.errstate(divide="ignore"):
            q2, q1 = (np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300)) / STEP), 1).astype(np.int64) for p in (p2, p1))
        coded, n = np.unique((bucket_of(word[0][before]) << 40) + ((1 << 19) + q2 << 20) + (1 << 19) + q1, return_counts=True)
        return {"bucket": coded >> 40, "q2": (coded >> 20 & 0xFFFFF) - (1 << 19), "q1": (coded & 0xFFFFF) - (1 << 19), "n": n}

    late = [x.where(F.col("part") == HELD) for x in (blocks, words, pairs)]
    found = _with_replies(*late, binned, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("bucket", "q2", "q1").toPandas()
    p2, p1 = (np.where(found[q] > 0, 0.0, np.exp(found[q].to_numpy(np.float64) * STEP)) for q in ("q2", "q1"))
    return np.column_stack([found.bucket.to_numpy(np.float64), found.n.to_numpy(np.float64), p2, p1, np.full(len(found), 1.0 / (distinct + 1))])


def score_documents(docs: DataFrame, training: Column, held: Column, id_col: str = "doc_id", text_col: str = "text", *, block_tokens: int = BLOCK_TOKENS, read_bytes: int = READ_BYTES, slot_keys: int = SLOT_KEYS) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``training`` is true for the documents to learn from, ``held`` for those of
    them whose tokens teach the mixture weights. ``score`` is the model's log10
    probability of the text, ``base_score`` the sum over tokens of log10 of the
    smoothed share of the word in the training tokens. A null text counts as an
    empty one and has the end token alone; null ids are kept; every row gets its
    own result, repeated or not. A very long text is read in pieces. Other columns
    are ignored, whatever their names; an empty table gives an empty result, and
    without training documents all words are unknown and equally likely. The
    options bound what a task holds and do not change results.
    """
    part = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(held, F.lit(False)), HELD).otherwise(MAIN)).otherwise(OTHER)
    blocks = materialise(tokenised(docs, part, id_col, text_col, block_tokens, read_bytes), "lm-blocks")
    count = lambda column, width, *parts: F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.octet_length(column) / width)), F.lit(0)).cast("long")
    main_tokens, n, keys, tokens = blocks.agg(count("tokens", 4, MAIN), count("tokens", 4, MAIN, HELD), count("words", 8, MAIN, HELD, OTHER), count("tokens", 4, MAIN, HELD, OTHER)).first()
    least = docs.sparkSession.sparkContext.defaultParallelism
    slots = lambda held: max(least, -(-held // slot_keys))
    words = materialise(exchange(blocks.select("block", "part", "words", "counts"), _block_words, slots(keys)), "lm-words")
    pairs = materialise(exchange(blocks.select("block", "part", "lengths", "words", "tokens"), _block_pairs, slots(tokens)), "lm-pairs")
    v = words.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    # Nothing learnt: every word is unknown, and there is one unknown word.
    weights = learn_weights(_held_out_events(blocks, words, pairs, main_tokens, v)) if n else np.tile([0.0, 0.0, 1.0], (64, 1))

    def scored(ids, lengths, word, tokens, before, pair):
        counts = word[0] + word[1]
        p2, p1 = estimates(pair[0] + pair[1], counts[before], counts[tokens], n)
        w = weights[bucket_of(counts)][before]
        logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[tokens]
        known = (counts > 0)[tokens].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        return {"id": ids, "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat(known, starts), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts)}

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    found = _with_replies(blocks, words, pairs, scored, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

"""SentencePiece encoding by streaming Viterbi, and decoding.

A text is read once, left to right. For every boundary between characters the
best-scoring way there is known; a piece has a largest length, so only the last
that many boundaries can still be continued. Whenever the ways to all of these
meet in one boundary, what lies before is decided: its ids are committed and
forgotten, so a text of any length needs only the undecided window.

Where no piece of the vocabulary can reach across (before a run of spaces, and
on both sides of a character that no piece has) all ways meet at once. Between
two such places a text's ids depend on nothing outside, and short stretches are
remembered.

Model files of BPE type have merge ranks instead of log-probabilities. For
these a piece of rank r scores -log(r + 2) - log(log(pieces)), the
log-probability of rank r under Zipf's law.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size, released

SPACE = "▁"
#: Below the least score of a piece: the score of a character spelt in byte pieces.
SPELLING_PENALTY = 10.0
#: Boundaries after which a long stretch is checked for a decided prefix.
WINDOW = 4096
SHORT, REMEMBERED = 48, 100_000


class PieceCodec:
    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int]):
        """pieces: by id; the empty string for ids that text can't have. bytes_at: the ids of the 256 byte pieces."""
        import ahocorasick

        self.bytes_at = bytes_at
        self.longest = max(map(len, pieces), default=1)
        least = min((s for p, s in zip(pieces, scores, strict=True) if p), default=0.0)
        self.spelling = least - SPELLING_PENALTY
        self.matcher = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(zip(pieces, scores, strict=True)):
            if piece:
                self.matcher.add_word(piece, (len(piece), i, score))
        self.matcher.make_automaton()
        self.raw: list[bytes] = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(bytes_at):
            self.raw[i] = bytes([value])
        crossed = any(p[k] == SPACE and p[k - 1] != SPACE for p in pieces for k in range(1, len(p)))
        broken = any("\n" in p for p in pieces)
        # Stretches between places that no piece reaches across; a text is one stretch if pieces can hold inner spaces.
        self.stretches = re.compile(r"(?s).+" if crossed else r" +[^ ]*|[^ ]+" if broken else r"\n| +[^ \n]*|[^ \n]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        plain = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        scores = [p.get_score(i) for i in ids]
        ranks = [-scores[i] for i in plain]
        if all(r == int(r) for r in ranks) and len(set(ranks)) == len(ranks):  # merge ranks
            for i, r in zip(plain, ranks, strict=True):
                scores[i] = -math.log(r + 2) - math.log(math.log(len(plain)))
        pieces = [""] * len(ids)
        for i in plain:
            pieces[i] = p.id_to_piece(i)
        return cls(pieces, scores, [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def _spell(self, character: str) -> list[int]:
        return [self.bytes_at[b] for b in (" " if character == SPACE else character).encode()]

    def viterbi(self, stretch: str, window: int = WINDOW):
        """Yields ids of a stretch in which spaces are written as SPACE; memory is bounded by the undecided window."""
        first = 0  # the boundary that the lists begin at
        best, back, via = [0.0], [0], [-1]
        spelling = self.spelling
        checked = 0

        def path(to: int) -> list[int]:
            out: list[int] = []
            while to > first:
                i = via[to - first]
                out += [i] if i >= 0 else reversed(self._spell(stretch[to - 1]))
                to = back[to - first]
            out.reverse()
            return out

        for last, (n, i, score) in self.matcher.iter(stretch):
            to = last + 1
            while first + len(best) <= to:
                best.append(best[-1] + spelling)
                back.append(first + len(back) - 1)
                via.append(-1)
                if len(best) - checked > window:
                    # All boundaries that can still be continued, followed back until they meet.
                    ways = set(range(max(first, first + len(best) - 1 - self.longest), first + len(best) - 1))
                    while len(ways) > 1:
                        top = max(ways)
                        ways.discard(top)
                        ways.add(back[top - first])
                    (meet,) = ways
                    yield from path(meet)
                    cut = meet - first
                    best, back, via, first = best[cut:], back[cut:], via[cut:], meet
                    checked = len(best)
            at = to - n - first
            if at >= 0:
                value = best[at] + score
                if value > best[to - first]:
                    best[to - first], back[to - first], via[to - first] = value, to - n, i
        while first + len(best) <= len(stretch):
            best.append(best[-1] + spelling)
            back.append(first + len(back) - 1)
            via.append(-1)
            if len(best) > window and len(best) > 2 * self.longest:
                # No piece ends here any more: every way is this one.
                done = first + len(best) - 1
                yield from path(done)
                best, back, via, first = best[-1:], [done], [-1], done
        yield from path(len(stretch))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; none for an empty text.

        A SPACE character in the text itself is always spelt in byte pieces, so that decoding tells it from a space.
        """
        if SPACE in text:
            spelt = np.array([self.bytes_at[b] for b in SPACE.encode()], "<u4").tobytes()
            return spelt.join(map(self._encode, (" " + text).split(SPACE)))
        return self._encode(" " + text) if text else b""

    def _encode(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:  # what was asked for since the last time stays
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for stretch in self.stretches.findall(text):
            ids = known.get(stretch)
            if ids is None:
                ids = older.get(stretch)
                if ids is None:
                    ids = np.fromiter(self.viterbi(stretch.replace(" ", SPACE)), "<u4").tobytes()
                if len(stretch) <= SHORT:
                    known[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids; the space that encoding put first is taken off."""
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4")
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec.load(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, round_trip): the ids of each whole text, and whether decoding them gives it back.

    A null text counts as an empty one, which has no ids. Rows that repeat are
    encoded alike; other columns are ignored, whatever their names; an empty table
    gives an empty result. A text of any length is encoded in a bounded window.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(source):
        import pyarrow as pa

        own = codec(model)
        for batch in source:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_by_size(texts, 8 << 20):
                ids = [own.encode(t) for t in texts[a:b]]
                same = [own.decode(i) == t for i, t in zip(ids, texts[a:b], strict=True)]
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), listed, pa.array(same, pa.bool_())], names=["id", "ids", "round_trip"])

    return rows.mapInArrow(released(batches), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids array<int>); null ids count as none."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def batches(source):
        import pyarrow as pa

        own = codec(model)
        for batch in source:
            texts = [own.decode(np.array(i or [], "<u4")) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(released(batches), f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)

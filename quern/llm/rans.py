"""A range asymmetric numeral system for token ids, many interleaved lanes at a time, with NumPy.

A block's ids are dealt to ``LANES`` lanes in turn: step t holds ids t*LANES ..
of the block. Each lane is a coder of its own with a 63-bit state; all lanes
share one frequency table and one stream of 32-bit words. Every
``CHECKPOINT_STEPS`` steps the encoder notes the lanes' states and the place in
the stream, so that a decoder can begin there.
"""

from __future__ import annotations

import numpy as np

LANES = 4096
CHECKPOINT_STEPS = 128
#: Frequencies add up to 2^PRECISION.
PRECISION = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


def scale(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that add up to 2^PRECISION, each id that occurs with one at least."""
    total, size = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size // 2:
        raise ValueError("too many different ids for the precision")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total)).astype(np.int64)), 0)
    over = int(freq.sum()) - size
    order = np.argsort(-freq, kind="stable")
    while over:
        # Take from, or give to, the largest, never more than half of any.
        for i in order:
            step = min(over, int(freq[i]) // 2) if over > 0 else over
            freq[i] -= step
            over -= step
            if not over:
                break
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each of the 2^PRECISION slots; only decoding needs it."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[int], bytes]:
        """The stream of words, the stream places of the checkpoints, and the states at each (the first: at the start)."""
        n = len(ids)
        steps = -(-n // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words, places, states = [], [], []
        held = 0
        room = np.uint64(63 - PRECISION)
        for step in range(steps - 1, -1, -1):  # decoding runs the other way
            own = ids[step * LANES : (step + 1) * LANES]
            x, f = state[: len(own)], self.freq[own]
            full = x >= (f << room)
            if full.any():
                out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                words.append(out)
                held += len(out)
                x = np.where(full, x >> WORD, x)
            q = x // f
            state[: len(own)] = (q << np.uint64(PRECISION)) + (x - q * f) + self.start[own]
            if step % CHECKPOINT_STEPS == 0:
                places.append(held)
                states.append(state.astype("<u8").tobytes())
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        return stream.tobytes(), [len(stream) - p for p in reversed(places)], b"".join(reversed(states))

    def decode(self, n: int, stream: bytes, places: list[int], states: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, or those from checkpoint ``part`` up to the next."""
        data, steps = np.frombuffer(stream, "<u4").astype(np.uint64), -(-n // LANES)
        first, last = (0, steps) if part is None else (part * CHECKPOINT_STEPS, min(steps, (part + 1) * CHECKPOINT_STEPS))
        if first >= last:
            return np.zeros(0, np.uint32)
        at = places[first // CHECKPOINT_STEPS]
        state = np.frombuffer(states, "<u8")[first // CHECKPOINT_STEPS * LANES :][:LANES].copy()
        out = np.zeros(min(n, last * LANES) - first * LANES, np.uint32)
        mask, precision = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
        for step in range(first, last):
            lanes = min(LANES, n - step * LANES)
            x = state[:lanes]
            slot = x & mask
            own = self.slots[slot.astype(np.int64)]
            out[(step - first) * LANES : (step - first) * LANES + lanes] = own
            x = self.freq[own] * (x >> precision) + slot - self.start[own]
            short = x < LOW
            need = int(np.count_nonzero(short))
            if need:
                x[short] = (x[short] << WORD) | data[at : at + need]
                at += need
            state[:lanes] = x
        return out

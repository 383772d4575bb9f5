"""Winnowed anchors: from every byte string of a fixed length the same one of its k-byte grams is picked, wherever the string stands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that are worked on at a time; longer texts are cut into pieces that overlap by all but one byte of the length.
PIECE = 1 << 19
_BITS = 20  # positions in a piece fit


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hasher:
    """Polynomial hashes of any substring of a piece, from prefix sums modulo 2^64 of random values for each byte."""

    def __init__(self, seed: int, n: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((prefix[stop] - prefix[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits, so that its order is as good as random."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Runs:
    """Runs of neighbouring windows with the same anchor: text number, hash of the anchor, hash of the bytes that the run's windows cover, position of the anchor, first and last start of a window."""

    text: np.ndarray
    anchor: np.ndarray
    cover: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Winnower:
    """Picks the k-byte gram with the least hash, the leftmost of equals, from each window of `length` bytes."""

    def __init__(self, length: int = 200, k: int = 64):
        if not 1 <= k <= length or length * 4 > PIECE:
            raise ValueError("k is from 1 to length, and length far below a piece")
        self.length, self.k = length, k
        room = PIECE + length + 1
        self.order, self.content = _Hasher(1, room), _Hasher(2, room)

    def runs(self, texts: list[bytes]) -> Runs:
        """The runs of all texts, positions counted from each text's start."""
        out: list[tuple[np.ndarray, ...]] = []
        queue: list[tuple[int, int, bytes]] = []
        held = 0
        for n, text in enumerate(texts):
            step = PIECE - self.length + 1
            for start in range(0, max(0, len(text) - self.length + 1), step):
                part = text[start : start + PIECE]
                if held + len(part) > PIECE:
                    out.append(self._piece(queue))
                    queue, held = [], 0
                queue.append((n, start, part))
                held += len(part)
        if queue:
            out.append(self._piece(queue))
        if not out:
            return Runs(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64)))
        return Runs(*(np.concatenate(c) for c in zip(*out, strict=True)))

    def _piece(self, queue: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(q[2] for q in queue), dtype=np.uint8)
        sizes = np.array([len(q[2]) for q in queue])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        prefix = self.order.prefix(data)
        grams = len(data) - self.k + 1
        hashes = mixed((prefix[self.k :] - prefix[:grams]) * self.order.down[:grams])
        low = np.uint64((1 << _BITS) - 1)
        keys = (hashes & ~low) | np.arange(grams, dtype=np.uint64)
        width, span = self.length - self.k + 1, 1
        best = keys
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < width:
            more = width - span
            best = np.minimum(best[:-more], best[more:])
        chosen = (best & low).astype(np.int64)
        whole = np.ones(len(chosen) + self.length, dtype=bool)
        for e in ends.tolist():
            whole[max(0, e - self.length + 1) : e] = False
        at = np.flatnonzero(whole[: len(chosen)])
        picked = chosen[at]
        cut = np.flatnonzero((picked[1:] != picked[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        lo, hi = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
        a = chosen[lo]
        cover = self.content.of(self.content.prefix(data), lo, hi + self.length)
        cover = mixed(cover ^ ((hi - lo) * 1009 + (a - lo)).astype(np.uint64))
        q = np.searchsorted(ends, lo, side="right")
        shift = np.array([x[1] for x in queue])[q] - starts[q]
        return np.array([x[0] for x in queue])[q], hashes[a], cover, a + shift, lo + shift, hi + shift

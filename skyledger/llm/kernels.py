"""Numpy kernels on words: hashing, shingles, and fragments of a global n-gram order."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd number; words are hashed as polynomials in it.
ROOT = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; a longer word takes more.
CHUNK = 2**16
_POWERS = [np.zeros(0, U), np.zeros(0, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    out = h >> U(30)
    out ^= h
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(27)
    out *= U(0x94D049BB133111EB)
    out ^= out >> U(31)
    return out


#: A number for each byte.
BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ROOT and of its inverse, modulo 2^64; kept as long as the worker lives."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        for i, base in enumerate((ROOT, pow(ROOT, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes raw[start:end], in order and apart: sums of a number for each byte times a power of ROOT for its place.

    Sums run over a chunk of whole spans at a time, and a span's own is a difference of two, moved back to place 0.
    """
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        up, down = _powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, U)
        np.cumsum(BYTES[raw[base : base + int(e[-1])]] * up[:-1], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes: what stands between \\x20 and \\x09-\\x0D."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def to_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case (bytes.lower leaves other letters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def split_units(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all units in a row, and each unit's number of words [^\\x20\\x09-\\x0D]+."""
    raw = np.frombuffer(b" ".join(units), np.uint8)
    starts, ends = word_spans(raw)
    begins = np.cumsum([0] + [len(u) + 1 for u in units], dtype=np.int64)
    return span_hashes(raw, starts, ends), np.diff(np.searchsorted(starts, begins))


def split_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines of all texts in a row, the number of words of each line, the number of lines of each text."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    starts, ends = word_spans(raw)
    begins = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw) + 1]]) if texts else np.zeros(1, np.int64)
    return span_hashes(raw, starts, ends), np.diff(np.searchsorted(starts, begins)), np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def distinct_by_unit(made: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each unit in rising order: (unit of each, value, count per unit); made: values per unit, in a row."""
    at = 0
    for n in made.tolist():
        if n > 1:
            values[at : at + n].sort()
        at += n
    unit = np.repeat(np.arange(len(made)), made)
    keep = np.ones(len(values), bool)
    keep[1:] = (unit[1:] != unit[:-1]) | (values[1:] != values[:-1])
    unit, values = unit[keep], values[keep]
    return unit, values, np.bincount(unit, minlength=len(made))


def shingle_sets(units: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each unit as 64-bit hashes; a unit of fewer words has its whole sequence as one."""
    h, counts = split_units(units)
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    unit = np.repeat(np.arange(len(units)), made)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(made) - made, made) + starts[unit]
    last = ends[unit]
    acc = np.zeros(len(unit), U)
    for k in range(n):
        there = at + k < last
        part = h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else acc
        # the constant stands for a place without a word, so that sequences of different lengths differ
        acc = mix(acc * U(0x9E3779B97F4A7C15) + np.where(there, part, U(0x5851F42D4C957F2D)))
    return distinct_by_unit(made, acc)


def set_sums(unit: np.ndarray, values: np.ndarray, units: int) -> np.ndarray:
    """Sum of the values of each unit, modulo 2^64; unit rises."""
    total = np.zeros(units, U)
    if len(unit):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        total[unit[first]] = np.add.reduceat(values, first)
    return total


def signatures(unit: np.ndarray, values: np.ndarray, units: int) -> np.ndarray:
    """128 bits for each set, as rows of two numbers."""
    return np.stack([mix(set_sums(unit, mix(values), units)), mix(set_sums(unit, mix(values ^ U(0xA5A5A5A5A5A5A5A5)), units) + U(1))], axis=1)


class Fragments:
    """Keys that two sets of Jaccard similarity >= num / den are sure to share.

    The global order of shingles is that of their hashes. It is cut into fragments, more of
    them than two similar sets of a size class can have differences, so some fragment holds
    the same shingles in both: what a set holds in a fragment is a key.

    Sets x and y, |x| <= |y|, differ in at most (|x| + |y|) (den - num) / (den + num) <= slack(|y|) shingles.
    Small sets (slack 0 or 1) have as keys the whole set, and the set without each one of its shingles.
    Others belong to a class by size; a set also has the keys of the next class, if a similar set can be there.
    An empty fragment is a key only for a set with no more than slack fragments in use: if either
    set has more, a fragment in use is the same in both.
    """

    #: Larger classes give more sets one class only, and more fragments than their size needs; about 1.5 has the fewest keys.
    GROWTH = 1.5

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.small = next(n for n in range(1, 10**6) if self.slack(n + 1) > 1)
        bounds = [self.small + 1]
        while bounds[-1] < 2**40:
            # the next class holds the largest similar sets of this one
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * self.GROWTH), bounds[-1] * den // num))
        self.bounds = np.array(bounds, np.int64)
        slack = np.array([self.slack(int(b) - 1) for b in bounds[1:]], np.int64)
        self.slacks = slack
        self.cuts = np.where(slack < 8, 2 * slack + 2, slack + np.maximum(4, slack // 10 + 1))

    def slack(self, n: int) -> int:
        return 2 * n * (self.den - self.num) // (self.den + self.num)

    def keys(self, unit: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, key) of all keys, and how many of its keys a unit has in common with a similar set at least; unit, values and counts as distinct_by_unit gives them.

        A set with more fragments in use than slack has that many more in common with any similar set, in the class of the larger one.
        """
        out = [self._small(unit, values, counts)]
        common = np.full(len(counts), 2**31 - 1, np.int64)
        which = np.searchsorted(self.bounds, counts, side="right") - 1
        # the largest similar set has counts * den / num shingles
        most = np.searchsorted(self.bounds, counts * self.den // self.num, side="right") - 1
        for level, chosen in ((which, which >= 0), (which + 1, (most > which) & (counts > 0))):
            of, made, used = self._cut(unit, values, counts, level, chosen)
            out.append((of, made))
            least = np.maximum(1, used - self.slacks[np.maximum(level, 0)])
            common = np.where(chosen, np.minimum(common, least), common)
        common[counts <= self.small] = 1
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), common

    def _small(self, unit, values, counts):
        chosen = (counts > 0) & (counts <= self.small)
        take = chosen[unit]
        u, m = unit[take], mix(values[take])
        total = set_sums(u, m, len(counts))
        whole = np.flatnonzero(chosen)
        loose = np.array([self.slack(n) for n in range(self.small + 1)])[counts[u]] > 0
        return np.concatenate([whole, u[loose]]), mix(np.concatenate([total[whole], total[u[loose]] - m[loose]]))

    def _cut(self, unit, values, counts, which, chosen):
        take = chosen[unit]
        u, v = unit[take], values[take]
        if not len(u):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(counts), np.int64)
        cuts = self.cuts[np.maximum(which, 0)]
        frag = (((v >> U(32)) * cuts[u].astype(U)) >> U(32)).astype(np.int64)
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (frag[1:] != frag[:-1])
        first = np.flatnonzero(new)
        ku, kf = u[first], frag[first]
        sums = np.add.reduceat(mix(v), first)
        tag = mix((which[ku].astype(U) << U(40)) + kf.astype(U) + U(1))
        keys = mix(sums + tag)
        used = np.bincount(ku, minlength=len(counts))
        few = chosen & (used <= self.slacks[np.maximum(which, 0)])
        if few.any():
            more_u, more_k = [], []
            for i in np.flatnonzero(few):
                empty = np.setdiff1d(np.arange(cuts[i]), kf[ku == i])
                more_u.append(np.full(len(empty), i))
                more_k.append(mix(mix((U(which[i]) << U(40)) + empty.astype(U) + U(1))))
            ku, keys = np.concatenate([ku, *more_u]), np.concatenate([keys, *more_k])
        return ku, keys, used

"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed A* search over the lattice.

A node of the search is a set of segmentations: those that agree with a sampled one before some piece and differ in it. Its
mass is the product of the pieces before and of what the sampled piece leaves. Its perturbed score is the greatest Gumbel of its
members, drawn at once: Gumbel(log mass), held under the score of the node that it was split from. The node of the highest
score is opened first; its best member is a draw from its members (so it is a new segmentation), and the rest of the node falls
apart into one node for each later piece. Members come out by falling score: a sample without replacement.

Arrays hold a slice of texts at once: the lattices of its different units, then one walk for all texts per draw. Random
numbers are hashes of (seed, key and text; draw; unit; step), so a segmentation does not depend on what else is in the slice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import kernels as K
from .lines import slices

BAR = "▁"
#: Texts of a slice: so many rows or bytes, whichever comes first; a longer text is one of its own.
SLICE_ROWS, SLICE_TEXT = 2000, 2**20
WORD = 2**64 - 1
#: Units whose lattices a worker keeps; what else a slice has is built for it.
BASE_UNITS = 120_000
_MODELS: dict[tuple[str, float], "Pieces"] = {}


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, rows: list, dtype):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.array([x for r in rows for x in r], dtype)

    def extended(self, rows: list) -> Ragged:
        more, out = Ragged(rows, self.flat.dtype), Ragged([], self.flat.dtype)
        out.size, out.flat = np.concatenate([self.size, more.size]), np.concatenate([self.flat, more.flat])
        out.at = np.concatenate([self.at, more.at + len(self.flat)])
        return out

    def followed(self, other: Ragged, start: int) -> Ragged:
        """These rows and then the other's from start on."""
        if start == len(other.size):
            return self
        out, skipped = Ragged([], self.flat.dtype), int(other.at[start])
        out.size, out.flat = np.concatenate([self.size, other.size[start:]]), np.concatenate([self.flat, other.flat[skipped:]])
        out.at = np.concatenate([self.at, other.at[start:] - skipped + len(self.flat)])
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows one after another, and their lengths."""
        size = self.size[rows]
        if len(rows) == int(size.sum()) and (size == 1).all():
            return self.flat[self.at[rows]], size
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[rows] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class Pieces:
    """Pieces of a model and a trie of them.

    The pieces' log-probabilities follow Zipf's law by rank in the vocabulary file, -power * log(rank + 1): the file's
    tokenizer was made by merges and has ranks only. A character that no piece holds is its UTF-8 byte pieces.
    """

    def __init__(self, path: str, power: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        known, ids, self.bytes = [], [], {}
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                known.append(sp.id_to_piece(i))
                ids.append(i)
        if any(BAR in p.lstrip(BAR) for p in known):
            raise ValueError("a piece reaches over a word boundary")
        self.base: tuple[Lattices, dict[str, int]] | None = None
        self.buffers: dict[str, np.ndarray] = {}
        self.cost = -power * np.log(np.arange(2, len(known) + 2))
        self.byte_cost = -power * math.log(len(known) + 2)
        self.longest = max(map(len, known))
        # a character that only single pieces or bytes can stand for parts units too
        joined = set("".join(p for p in known if len(p) > 1))
        self.units = re.compile(f"{BAR}*[^{BAR}\\n]+|{BAR}+|\\n" if "\n" not in joined else f"{BAR}*[^{BAR}]+|{BAR}+")
        self.ids = Ragged([[i] for i in ids], np.uint32)
        self.text = Ragged([p.replace(BAR, " ").encode() for p in known], np.uint8)
        self.alphabet = np.array(sorted({ord(c) for p in known for c in p}), np.int64)
        place = {chr(c): i for i, c in enumerate(self.alphabet.tolist())}
        nodes, edges = {"": 0}, {}
        self.width = len(place)
        for p in known:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges[nodes[p[: n - 1]] * self.width + place[p[n - 1]]] = nodes[p[:n]]
        # moves of the trie in an open hash table, a quarter of it in use at most
        bits = (4 * len(edges)).bit_length()
        self.shift, self.mask = K.U(64 - bits), 2**bits - 1
        self.moves, self.reach = np.full(2**bits, -1, np.int64), np.full(2**bits, -1, np.int64)
        for move, to in edges.items():
            at = int(self._slot(np.array([move]))[0])
            while self.moves[at] >= 0:
                at = (at + 1) & self.mask
            self.moves[at], self.reach[at] = move, to
        self.head = np.full(self.width + 1, -1, np.int64)
        for c, i in place.items():
            self.head[i] = nodes.get(c, -1)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[[nodes[p] for p in known]] = np.arange(len(known))

    def _slot(self, move: np.ndarray) -> np.ndarray:
        return (move.astype(K.U) * K.U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of the trie, or -1."""
        move = np.where(char >= 0, node * self.width + char, -2)
        at = self._slot(move)
        seen = self.moves[at]
        out = np.where(seen == move, self.reach[at], -1)
        on = np.flatnonzero((seen != move) & (seen >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            seen = self.moves[at[on]]
            hit = seen == move[on]
            out[on[hit]] = self.reach[at[on[hit]]]
            on = on[~hit & (seen >= 0)]
        return out


class Lattices:
    """Lattices of units (a run of bars and what follows up to the next bar): no piece reaches over the start of a unit.

    A state is a place in a unit; states stand in the order of what is left of their units. Each has an edge per piece, with
    the probability that a segmentation goes on by it. target: the state that an edge leads to, -1 at the end of the unit.
    """

    def __init__(self, model: Pieces, units: list[str]):
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(length) - length
        left = np.repeat(begin + length, length) - np.arange(len(codes))
        at = np.minimum(np.searchsorted(model.alphabet, codes), len(model.alphabet) - 1)
        char = np.where(model.alphabet[at] == codes, at, -1) if len(codes) else codes
        alive, node, found = np.arange(len(codes)), model.head[char], []
        for size in range(1, model.longest + 1):
            there = node >= 0
            alive, node = alive[there], node[there]
            if not len(alive):
                break
            piece = model.piece[node]
            hit = piece >= 0
            found.append((alive[hit], size, piece[hit]))
            on = left[alive] > size
            alive, node = alive[on], node[on]
            node = model.step(node, char[alive + size])
        single = np.zeros(len(codes), bool)
        single[[x for x in found if x[1] == 1][0][0] if found else []] = True
        odd = np.flatnonzero(~single)
        rare, which = np.unique(codes[odd], return_inverse=True)
        spelt = [chr(c).encode("utf-8", "replace") for c in rare.tolist()]
        self.ids = model.ids.extended([[model.bytes[b] for b in s] for s in spelt])
        self.text = model.text.extended(spelt)
        cost = np.concatenate([model.cost, [model.byte_cost * len(s) for s in spelt]])
        found.insert(0, (odd, 1, which.astype(np.int64) + len(model.cost)))

        state = np.empty(len(codes), np.int64)
        most = int(left.max(initial=0))
        by_left = np.argsort(left.astype(np.int16) if most < 2**15 else left, kind="stable")
        state[by_left] = np.arange(len(codes))
        self.degree = np.zeros(len(codes), np.int64)
        for pos, _, _ in found:
            self.degree[state[pos]] += 1
        self.first = np.cumsum(self.degree) - self.degree
        self.of = np.repeat(np.arange(len(codes)), self.degree)
        self.piece, self.target = np.empty(len(self.of), np.int64), np.empty(len(self.of), np.int64)
        free = self.first.copy()
        for pos, size, piece in found:  # the edges of a state come by rising size
            of = state[pos]
            at = free[of]
            free[of] += 1
            self.piece[at] = piece
            self.target[at] = np.where(left[pos] == size, -1, state[np.minimum(pos + size, len(codes) - 1)])
        self.start = state[begin] if len(codes) else begin
        weight = cost[self.piece]
        # beta: the logarithm of what all ways from a state to the end of its unit sum to; the last entry is the end
        beta = np.zeros(len(codes) + 1)
        bounds = np.searchsorted(left[by_left], np.arange(1, most + 2))
        self.logp = np.empty(len(weight))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e0 = self.first[lo]
            e1 = self.first[hi - 1] + self.degree[hi - 1]
            s = weight[e0:e1] + beta[self.target[e0:e1]]
            heads, d = self.first[lo:hi] - e0, self.degree[lo:hi]
            top = np.maximum.reduceat(s, heads)
            beta[lo:hi] = total = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, d)), heads))
            self.logp[e0:e1] = s - np.repeat(total, d)
        prob = np.exp(self.logp)
        before, after = np.zeros(len(weight)), np.zeros(len(weight))
        last = self.first + self.degree - 1
        for j in range(1, int(self.degree.max(initial=1))):
            more = self.degree > j
            i = self.first[more] + j
            before[i] = before[i - 1] + prob[i - 1]
            i = last[more] - j
            after[i] = after[i + 1] + prob[i + 1]
        self.upto = before + prob
        self.upto[last] = np.inf  # whatever rounding leaves is the last edge's
        with np.errstate(divide="ignore"):
            self.rest = np.log(before + after)  # of the other edges of the state
        for name in ("degree", "first", "of", "piece", "target", "start"):
            setattr(self, name, getattr(self, name).astype(np.int32))

    def joined(self, other: Lattices, model: Pieces) -> Lattices:
        """These lattices and then the other's, in the model's buffers: what stood there behind these lattices is overwritten."""
        out = Lattices.__new__(Lattices)
        states, edges, known = len(self.degree), len(self.of), len(model.ids.size)
        out.ids, out.text = self.ids.followed(other.ids, known), self.text.followed(other.text, known)
        moved = np.where(other.piece >= known, other.piece + len(self.ids.size) - known, other.piece)
        changed = {"first": other.first + edges, "of": other.of + states, "piece": moved, "target": np.where(other.target < 0, -1, other.target + states), "start": other.start + states}
        for name in ("degree", "first", "of", "piece", "target", "start", "logp", "upto", "rest"):
            own, more = getattr(self, name), changed.get(name, getattr(other, name))
            size = len(own) + len(more)
            room = model.buffers.get(name)
            if room is None or len(room) < size:
                room = np.empty(2 * size, own.dtype)
                room[: len(own)] = own
                model.buffers[name] = room
            room[len(own) : size] = more
            setattr(out, name, room[:size])
        return out

    def walk(self, starts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each state to the end of its unit, all at once; marks: what a path's random numbers are hashed from.

        The edges by start and step, and how many each start has; a start of -1 has none.
        """
        who = np.flatnonzero(starts >= 0)
        state, steps, count = starts[who], [], np.zeros(len(starts), np.int64)
        while len(who):
            r = uniform(marks[who] + K.U(len(steps) * 0x9E3779B97F4A7C15 & WORD))
            edge = self.first[state]
            on = np.flatnonzero(r >= self.upto[edge])
            while len(on):
                edge[on] += 1
                on = on[r[on] >= self.upto[edge[on]]]
            count[who] += 1
            steps.append((who, edge))
            state = self.target[edge]
            ahead = state >= 0
            who, state = who[ahead], state[ahead]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for n, (who, edge) in enumerate(steps):
            out[begin[who] + n] = edge
        return out, count


def known_lattices(model: Pieces, units: list[str]) -> tuple[Lattices, np.ndarray]:
    """Lattices with all units and the number of each; those of the first BASE_UNITS or so are kept with the model."""
    if model.base is None:
        model.base = Lattices(model, []), {}
    lat, number = model.base
    at = np.fromiter(map(number.get, units, repeat(-1)), np.int64, len(units))
    absent, new = np.flatnonzero(at < 0), {}
    at[absent] = [new.setdefault(units[i], len(number) + len(new)) for i in absent.tolist()]
    lat = lat.joined(Lattices(model, list(new)), model)
    if len(number) < BASE_UNITS:
        number.update(new)
        model.base = lat, number
    return lat, at


def pieces(path: str, power: float) -> Pieces:
    if (path, power) not in _MODELS:
        _MODELS[path, power] = Pieces(path, power)
    return _MODELS[path, power]


def normalize(text: str | None) -> str:
    """Blanks become bars, with one bar before the text; an empty text stays empty."""
    return BAR + text.replace(" ", BAR) if text else ""


def uniform(marks: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 (neither is one of them) out of 64-bit marks."""
    return ((K.mix(marks) >> K.U(12)).astype(np.float64) + 0.5) * 2.0**-52


def _mark(seed: int, *parts: int) -> int:
    """A 64-bit number out of a seed and small numbers (K.mix, on plain integers)."""
    for p in parts:
        seed = (seed + (p + 1) * 0xD6E8FEB86659FD93) & WORD
        seed = (seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9 & WORD
        seed = (seed ^ (seed >> 27)) * 0x94D049BB133111EB & WORD
        seed ^= seed >> 31
    return seed


def _under(loc, top: float, r):
    """Gumbel(loc), given that it is below top: exp(-g) is exponential with rate exp(loc), over exp(-top)."""
    return -np.logaddexp(-top, np.log(-np.log(r)) - loc)


class Draws:
    """k segmentations or fewer of each text of a slice, and the score of the first one left out; good until the next slice's.

    found[i]: (score, logp, edges) by falling score; threshold[i]: the next score, None if the text has no further segmentation.
    """

    def __init__(self, texts: list[str | None], seeds: list[int], model: Pieces, k: int):
        cut = [model.units.findall(normalize(t)) for t in texts]
        self.lat, at = known_lattices(model, list(chain.from_iterable(cut)))
        starts = self.lat.start[at]
        ends = np.cumsum([len(u) for u in cut])
        self.starts = [starts[e - len(u) : e] for u, e in zip(cut, ends.tolist())]
        self.seeds, self.k = seeds, k
        self.found: list[list] = [[] for _ in texts]
        # a node: score, path that it was split from, place in it, edges that are spent there; what opens first has no path
        self.nodes: list[list] = [[(float(-np.log(-np.log(uniform(np.array([s], K.U))[0]))), None, 0, ())] for s in seeds]
        for turn in range(k):
            self._draw(turn)
        self.threshold = [max((n[0] for n in nodes), default=None) for nodes in self.nodes]

    def _draw(self, turn: int) -> None:
        lat, opened, starts = self.lat, [], []
        for i, nodes in enumerate(self.nodes):
            if not nodes:
                continue
            best = max(range(len(nodes)), key=lambda j: nodes[j][0])
            top, source, place, spent = nodes.pop(best)
            seed = _mark(self.seeds[i], turn, 1)
            if source is None:
                head, unit, todo = np.zeros(0, np.int64), 0, self.starts[i]
            else:
                path, unit_of = source
                state = lat.of[path[place]]
                free = [e for e in range(int(lat.first[state]), int(lat.first[state] + lat.degree[state])) if e not in spent]
                p = np.exp(lat.logp[free])
                r, r2 = uniform(np.array([_mark(seed, 1), _mark(seed, 2)], K.U))
                edge = free[min(int(np.searchsorted(np.cumsum(p), r * p.sum(), side="right")), len(free) - 1)]
                rest = [e for e in free if e != edge]
                left = float(np.exp(lat.logp[rest]).sum())
                if left > 0:
                    loc = float(lat.logp[path[:place]].sum()) + math.log(left)
                    nodes.append((float(_under(loc, top, r2)), source, place, (*spent, edge)))
                head, unit = np.append(path[:place], edge), int(unit_of[place])
                todo = np.append(lat.target[edge], self.starts[i][unit + 1 :])
            opened.append((i, top, head, unit, source, place, seed))
            starts.append(todo)
        if not opened:
            return
        # of all texts at once: the marks of the units, the walks, and the logarithms along them
        size = np.array([len(x) for x in starts])
        ends = np.cumsum(size)
        unit_at = np.arange(ends[-1]) + np.repeat(np.array([o[3] for o in opened]) - ends + size, size)
        marks = K.mix(np.repeat(np.array([o[6] for o in opened], K.U), size) + unit_at.astype(K.U) * K.U(0xA0761D6478BD642F))
        tails, counts = lat.walk(np.concatenate(starts), marks)
        every_log, every_rest = lat.logp[tails], lat.rest[tails]
        steps = np.concatenate([[0], np.cumsum(counts)])
        unit_of_step = np.repeat(unit_at.astype(np.int32), counts) if turn + 1 < self.k else None
        split, some = [], self.k - turn
        for (i, top, head, unit, source, place, seed), a, b in zip(opened, steps[ends - size].tolist(), steps[ends].tolist()):
            path, logs, units = tails[a:b], every_log[a:b], None
            before = 0.0
            if unit_of_step is not None:
                units = unit_of_step[a:b]
            if source is not None:
                head_logs = lat.logp[head]
                before = float(head_logs.sum())
                path = np.concatenate([head, path])
                if units is not None:
                    units = np.concatenate([source[1][:place], np.array([unit], np.int32), units])
            self.found[i].append((top, before + float(logs.sum()), path))
            loc = before + np.cumsum(logs) - logs + every_rest[a:b]
            later = np.flatnonzero(loc > -np.inf)
            # the best nodes, as many as are drawn yet and the first one left out
            if len(later) > some:
                # log(-log(r)) lies between -36.8 and 3.6: nodes so far below the others are not among the best
                later = later[loc[later] >= np.partition(loc[later], -some)[-some] - 41.5]
            if len(later):
                split.append((i, top, len(head), (path, units), _mark(seed, 3), later, loc[later]))
        if not split:
            return
        size = np.array([len(x[5]) for x in split])
        ends = np.cumsum(size)
        mark = np.repeat(np.array([x[4] for x in split], K.U), size) + np.concatenate([x[5] for x in split]).astype(K.U) * K.U(0xE7037ED1A0B428DB)
        every_noise = np.log(-np.log(uniform(K.mix(mark)))) - np.concatenate([x[6] for x in split])
        for (i, top, skipped, source, _, later, _), a, b in zip(split, (ends - size).tolist(), ends.tolist()):
            noise = every_noise[a:b]
            for j in np.argpartition(noise, some - 1)[:some].tolist() if len(later) > some else range(len(later)):
                where = int(later[j]) + skipped
                self.nodes[i].append((float(-np.logaddexp(-top, noise[j])), source, where, (int(source[0][where]),)))


def sample_text(text: str | None, model: Pieces, k: int, seed: int) -> list[tuple[bytes, float, float]]:
    """Up to k different segmentations of a text: (little-endian 32-bit ids, log-probability, perturbed score), by falling score.

    A text with fewer segmentations has all of them; an empty one has one, without pieces.
    """
    draws = Draws([text], [seed], model, k)
    return [(draws.lat.ids.take(draws.lat.piece[path])[0].astype("<u4").tobytes(), logp, score) for score, logp, path in draws.found[0]]


def inclusion(logp: float, threshold: float | None) -> float:
    """Probability that a segmentation's perturbed score passes the threshold (the next sample's score); 1 without one."""
    return 1.0 if threshold is None else -math.expm1(-math.exp(min(50.0, logp - threshold)))


def _cut_at(flat: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """The bytes of rows one after another, and where groups of rows (up to each of ends) begin and end."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat.tobytes(), [0, *upto[ends].tolist()]


def sample_segmentations(df: DataFrame, path: str, k: int = 2, seed: int = 0, power: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, n_pieces, log_prob, perturbed, inclusion, round_trip, ids_crc32, ids): k rows per row of df, or fewer.

    rank counts from 0 by falling perturbed score; inclusion: the probability that the segmentation is in the sample, given
    the score of the first one left out, for weights 1 / inclusion; round_trip: its ids decode to the text; ids: little-endian
    unsigned 32-bit numbers. The draw depends on seed, key and text alone: a task that runs again draws the same, and rows that
    repeat a key and a text have the same draws. A null text is empty, and has one segmentation without pieces; a null key
    is one more key; other columns are not read. An empty table gives none.
    """
    names = [key, "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids_crc32", "ids"]
    types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, power)
        for b in slices(batches, 1, SLICE_ROWS, SLICE_TEXT):
            texts = b.column(1).to_pylist()
            raw = [(" " + t).encode("utf-8", "replace") if t else b"" for t in texts]
            seeds = [xxhash.xxh64_intdigest(f"{seed} {name} {zlib.crc32(t[1:])}") for name, t in zip(b.column(0).to_pylist(), raw)]
            draws = Draws(texts, seeds, model, k)
            lat, at, rows = draws.lat, [], []
            for rank in range(k):
                drawn = [(i, *found[rank]) for i, found in enumerate(draws.found) if len(found) > rank]
                if not drawn:
                    break
                piece = lat.piece[np.concatenate([path_ for *_, path_ in drawn])]
                ends = np.cumsum([len(path_) for *_, path_ in drawn])
                ids, id_ends = _cut_at(*lat.ids.take(piece), ends)
                spelt, spelt_ends = _cut_at(*lat.text.take(piece), ends)
                for (i, score, logp, _), a, e, c, d in zip(drawn, id_ends, id_ends[1:], spelt_ends, spelt_ends[1:]):
                    own = ids[4 * a : 4 * e]
                    at.append(i)
                    rows.append((rank, e - a, logp, score, inclusion(logp, draws.threshold[i]), spelt[c:d] == raw[i], zlib.crc32(own), own))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, x) for c, x in zip(columns, types)]], names)

    kind = df.schema[key].dataType.simpleString()
    fields = "rank int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids_crc32 long, ids binary"
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {fields}")

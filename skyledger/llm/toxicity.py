"""Toxicity: words are restored from obfuscated spellings by a Viterbi search over character lattices, then scored.

The channel: a writer may put a digit or sign for a letter, repeat a letter, part letters by signs or blanks, or hide one
behind a star. The source: a character trigram model counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, schema_and

# What a sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "#": "h"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of characters: word boundary, a to z, any other letter, a digit or sign inside a word.
CLASSES, OTHER, SIGN = 29, 27, 28
LEET_COST, SEPARATOR_COST, REPEAT_COST, MASK_COST = -2.5, -1.5, -1.0, -3.5
SEPARATORS = set(".-_*'~,/\\`^:;")
EDGE = re.compile(r"^[\W_]{2,}(?=\w)|^[\"'(\[{<,.;:¿¡*_-]+(?=\w)|(?<=\w)[^\w\s]{2,}$|(?<=\w)[\"')\]}>,.;:?!*_-]+$")
ODD = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]|([^\W\d_])\1\1")
#: Three single characters or more, parted by blanks of any kind and number; shorter words have no features.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
TRIPLE = re.compile(r"(.)\1\1")
MAX_WORD = 40
CACHE_WORDS = 300_000


def class_of(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if ch == " ":
        return 0
    return OTHER if ch.isalpha() else SIGN


def byte_classes() -> np.ndarray:
    """Class of each byte of lower-cased UTF-8: bytes of other letters count as one class, signs that LEET lacks as boundaries."""
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[128:] = OTHER
    for ch in LEET:
        if ord(ch) < 128:
            table[ord(ch)] = SIGN
    return table


class CharModel:
    """log P(third | first, second): trigrams interpolated with bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0)
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        self.logp = np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)).tolist()


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Class trigrams over the whole texts of all rows; at most CLASSES ** 3 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_classes()
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for x in b.column(0):
                t = x.as_py()
                if t:
                    c = table[np.frombuffer(f"  {t}  ".encode("utf-8", "replace"), np.uint8)]
                    total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    out = np.zeros(CLASSES**3)
    for r in docs.select(text).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r["g"]] = r["n"]
    return out


def run_ends(word: str) -> list[int]:
    """For each place, where the run of equal characters that holds it ends."""
    ends = [len(word)] * len(word)
    for at in range(len(word) - 2, -1, -1):
        ends[at] = ends[at + 1] if word[at] == word[at + 1] else at + 1
    return ends


def arcs(word: str, at: int, end: int, parted: bool = False) -> list[tuple[int, str, float]]:
    """Ways on from a place in a run that ends at end: (next place, letters read, log-probability of the channel).

    A blank in a spaced run parts letters or words: both readings cost the same, the source model tells them apart.
    So does a separator if the word may be several (parted).
    """
    ch = word[at]
    if ch == " ":
        return [(at + 1, "", 0.0), (at + 1, " ", 0.0)]
    out = []
    if ch.isalpha():
        out.append((at + 1, ch, 0.0))
        if end - at >= 3 and (at == 0 or word[at - 1] != ch):
            out += [(end, ch, REPEAT_COST), (end, ch * 2, REPEAT_COST)]
        return out
    out.append((at + 1, ch, 0.0))
    out += [(end, c, LEET_COST) for c in LEET.get(ch, "")]
    if ch in SEPARATORS:
        out.append((end, "", SEPARATOR_COST))
        if parted:
            out.append((end, " ", SEPARATOR_COST))
    if ch == "*":
        out += [(at + 1, c, MASK_COST) for c in LETTERS]
    return out


def reading(node: tuple | None, stop: tuple | None = None) -> str:
    """What a path of nodes (node before, letters read, place) has read since stop."""
    out = []
    while node is not stop:
        out.append(node[1])
        node = node[0]
    return "".join(reversed(out))


def earlier(a: tuple, b: tuple) -> bool:
    """Whether path a reads what comes first in alphabetical order; only what follows the node that both share is read."""
    x, y = a, b
    while x is not y:
        if x[2] >= y[2]:
            x = x[0]
        else:
            y = y[0]
    return reading(a, x) < reading(b, x)


def viterbi(word: str, model: CharModel, parted: bool = False) -> str:
    """The likeliest reading; of equally likely ones the first in alphabetical order. Time is linear in the length."""
    logp, ends = model.logp, run_ends(word)
    root = (None, "", -1)
    states: list[dict[tuple[int, int], tuple[float, tuple]]] = [{} for _ in range(len(word) + 1)]
    states[0][(0, 0)] = (0.0, root)
    for at in range(len(word)):
        if not states[at]:
            continue
        ways = arcs(word, at, ends[at], parted)
        for (a, b), (score, path) in states[at].items():
            for end, read, cost in ways:
                x, y, s = a, b, score + cost
                for ch in read:
                    z = class_of(ch)
                    s += logp[x][y][z]
                    x, y = y, z
                old = states[end].get((x, y))
                new = (path, read, at)
                if old is None or s > old[0] or (s == old[0] and earlier(new, old[1])):
                    states[end][(x, y)] = (s, new)
        states[at] = {}
    final = [(s + logp[a][b][0], path) for (a, b), (s, path) in states[-1].items()]
    best = max(s for s, _ in final)
    return min(reading(path, root) for s, path in final if s == best)


class Restorer:
    """Restored words of texts; one search per different odd word, kept in a cache of bounded size.

    Words of plain letters have a lattice of one path and are taken as they are, in lower case. Odd words over MAX_WORD
    characters (addresses, rows of signs) may be several: separators can end a word there, and what stands between signs counts too.
    """

    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def word(self, token: str) -> str:
        if " " in token:
            return self.run(token)
        if token.isalpha() or (token[:-1].isalpha() and token[-1] in ".,"):
            w = token.lower() if token[-1] not in ".," else token[:-1].lower()
            return w if not TRIPLE.search(w) else viterbi(w, self.model)
        w = EDGE.sub("", EDGE.sub("", token.lower()))
        if not ODD.search(w):
            return w
        if len(w) > MAX_WORD:
            return " ".join(dict.fromkeys([*re.findall(r"[^\W\d_]+", w), *viterbi(w, self.model, parted=True).split()]))
        return viterbi(w, self.model)

    def tokens(self, text: str) -> list[str]:
        """Words between blanks, and runs of letters parted by blanks, each run one token with single blanks."""
        return text.split() + [" ".join(run.split()) for run in SPACED.findall(text)]

    def run(self, token: str) -> str:
        """The words of a spaced run by the likeliest reading, and the run read as one word."""
        if not any(ch.isalpha() for ch in token):
            return ""
        whole = self.word(token.replace(" ", ""))
        read = viterbi(token.lower(), self.model).split()
        return " ".join(read if whole in read else [*read, whole])

    def words(self, text: str) -> list[str]:
        out, cache = [], self.cache
        for token in self.tokens(text):
            w = cache.get(token)
            if w is None:
                w = self.word(token)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[token] = w
            out += w.split()
        return out


PREFIXES = (4, 5, 6)


def word_features(word: str) -> list[str]:
    """A word itself, and its beginnings (marked by a bar), which stand for inflected forms."""
    return [word] + [word[:k] + "|" for k in PREFIXES if len(word) > k] if len(word) > 2 else []


class Hits:
    """What of a lexicon the words of texts hit; each different word is restored and looked up once."""

    def __init__(self, restorer: Restorer, lexicon: dict[str, float]):
        self.restorer, self.lexicon = restorer, lexicon
        self.seen: set[str] = set()
        self.hot: dict[str, dict[str, float]] = {}

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        """(sum of the weights of different words that hit, greatest weight, hits per hundred words, logarithmic)."""
        tokens = self.restorer.tokens(text or "")
        different = set(tokens)
        if len(self.seen) > CACHE_WORDS:
            self.seen, self.hot = set(), {}
        for token in different - self.seen:
            for w in self.restorer.word(token).split():
                v = max((self.lexicon.get(f, 0.0) for f in word_features(w)), default=0.0)
                if v:
                    self.hot.setdefault(token, {})[w] = v
        self.seen |= different
        found = different & self.hot.keys()
        if not found:
            return 0.0, 0.0, 0.0
        hits = {w: v for t in found for w, v in self.hot[t].items()}
        n = sum(t in found for t in tokens)
        return math.fsum(hits.values()), max(hits.values()), math.log1p(100 * n / len(tokens))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    """What the tasks need: character model, lexicon (of bounded size) and the weights of the three hit features."""

    def __init__(self, chars: np.ndarray, lexicon: dict[str, float], weights: np.ndarray):
        self.chars, self.lexicon, self.weights = chars, lexicon, weights

    def scorer(self):
        hits, w = Hits(Restorer(CharModel(self.chars)), self.lexicon), self.weights

        def score(text: str | None) -> float:
            f = hits(text)
            z = float(np.dot(f, w[:3]) + w[3])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def lexicon_of(stats, n_bad: int, n_good: int, least: int = 8, ratio: float = 4.0, size: int = 4096) -> dict[str, float]:
    """Features with a smoothed log-odds over log(ratio), the size strongest ones; stats: (feature, bad, good) document counts."""
    out = []
    for f, bad, good in stats:
        if bad >= least:
            odds = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
            if odds > math.log(ratio):
                out.append((-odds * math.sqrt(bad), f, odds))
    return {f: odds for _, f, odds in sorted(out)[:size]}


def fit_toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "toxic", lexicon_size: int = 4096) -> ToxicityModel:
    """A model from labels (key, label): the character model from all docs, the lexicon and weights from at most max_rows labelled rows.

    The sample are the rows of the least hash of key. One half of it makes the lexicon, the other one the weights.
    Null labels and null keys teach nothing. Without rows of both labels every score is near the share of label 1 (0 if there are no rows).
    """
    chars = count_trigrams(docs, text)
    rows = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null")
    rows = rows.groupBy("_k").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_k", F.lit("toxicity"))).orderBy("_h", "_k").limit(max_rows)
    # at most max_rows rows of three numbers: a proven bound
    sample = scratch.cut(docs.select(key, text).join(F.broadcast(rows), F.col(key) == F.col("_k")).select("_y", F.pmod("_h", F.lit(2)).alias("_half"), F.col(text).alias("_t")).repartition(16))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharModel(chars))
        for b in batches:
            seen: dict[str, list[int]] = {"": [0, 0]}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y = 1 if y else 0
                seen[""][y] += 1
                for f in {f for w in set(restorer.words(t or "")) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["f", "bad", "good"])

    counted = sample.where("_half = 0").select("_y", "_t").mapInArrow(stats, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    strong = counted.where("bad >= 8 or f = ''").orderBy(F.col("f") != "", (F.col("bad") / (F.col("good") + 1)).desc(), F.col("bad").desc(), "f").limit(8 * lexicon_size)
    found = [(r["f"], r["bad"], r["good"]) for r in strong.collect()]
    n_bad, n_good = next(((b, g) for f, b, g in found if f == ""), (0, 0))
    lexicon = lexicon_of([x for x in found if x[0]], n_bad, n_good, size=lexicon_size)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Hits(Restorer(CharModel(chars)), lexicon)
        for b in batches:
            x = [found(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    got = sample.where("_half = 1").select("_y", "_t").mapInArrow(hits, "y int, a double, b double, c double").collect()
    got.sort(key=lambda r: (r["a"], r["b"], r["c"], r["y"]))  # the fit does not hang on the rows' order
    y = np.array([1.0 if r["y"] else 0.0 for r in got])
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.sum()) / (len(y) + 1), 1e-6), 1 - 1e-6)
        return ToxicityModel(chars, {}, np.array([0.0, 0.0, 0.0, math.log(share / (1 - share))]))
    return ToxicityModel(chars, lexicon, logistic(np.array([[r["a"], r["b"], r["c"]] for r in got]), y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs and out: the score in (0, 1) of every whole text, 1 likelier toxic. A null text is empty; no row is dropped; a column named out is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()  # the caches last as long as the task
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                made = pa.array([score(t) for t in part.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.mapInArrow(run, schema_and(docs, **{out: "double"}))

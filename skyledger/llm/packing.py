"""Best-fit packing: a configuration linear program over the length histogram.

Multiplicative weights price the lengths, a knapsack dynamic program finds the best configuration at these
prices, and the fractional solution is rounded; what rounding leaves goes by best fit.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch, schema_and

ROWS_PER_BUCKET = 100_000
#: Shares of the fractional solution that are tried; what is not taken goes by best fit.
ROUNDED = (1.0, 0.8, 0.5, 0.2)
#: The program is over classes of lengths, capacity / UNITS wide and rounded up; lengths up to SAND classes are left for the gaps.
UNITS, SAND = 64, 4
#: Words in each of the two generations of a worker's cache.
CACHE_WORDS = 200_000
_ENCODERS: dict[str, "WordEncoder"] = {}
#: What the tokenizer's pattern and Python's take for different kinds of characters.
CONTROL = regex.compile("[\x00-\x1f\x7f-\x9f]")


class WordEncoder:
    """Ids of words between ASCII white space, by the tokenizer of a file.

    The tokenizer drops white space and no token reaches over it, so a text's ids are those of its words in a row. Words are kept
    in a cache of two generations of bounded size. Where the file has the parts looked for below (NFC and lower case, the
    contraction pattern, byte-level letters), a new word of Latin letters goes to the tokenizer's model directly, else through all of it.
    """

    LATIN_END = 0x250

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = parts.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        norms = parts.get("normalizer") or {}
        norms = [n["type"] for n in norms.get("normalizers", [norms]) if n]
        self.pattern = None
        if norms == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
            if not all("<|" in t["content"] for t in parts["added_tokens"]):
                self.pattern = None
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            other = [b for b in range(256) if b not in set(plain)]
            # byte-level letters: bytes that print stand for themselves, the others follow from 256 on
            self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}

    def ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8")
        if self.pattern is None or (not word.isascii() and ord(max(text)) >= self.LATIN_END) or CONTROL.search(text) or "<|" in text:
            return self.tok.encode(text, add_special_tokens=False).ids
        if not word.isascii():
            text = unicodedata.normalize("NFC", text).lower()
        # letters, and letters with one mark after them, are what the pattern makes of most words
        if text.isalpha():
            pieces = [text]
        elif text[:-1].isalpha() and not text[-1].isalnum() and text[-1].isascii():
            pieces = [text[:-1], text[-1]]
        else:
            pieces = self.pattern.findall(text)
        out: list[int] = []
        for piece in pieces:
            if not piece.isascii():
                piece = "".join([self.letters[b] for b in piece.encode("utf-8")])
            out += [t.id for t in self.model.tokenize(piece)]
        return out

    def encode(self, text: str | None) -> bytes:
        young, old, out = self.young, self.old, []
        raw = (text or "").encode("utf-8", "replace")
        # added tokens are looked for before letters are lower-cased
        for w in [w if b"<|" in w else w.lower() for w in raw.split()] if b"<|" in raw else raw.lower().split():
            b = young.get(w)
            if b is None:
                b = old.get(w)
                if b is None:
                    ids = self.ids(w)
                    b = struct.pack(f"<{len(ids)}I", *ids)
                young[w] = b
            out.append(b)
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return b"".join(out)


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return [_ENCODERS[path].encode(t) for t in texts]


def token_pieces(df: DataFrame, path: str, capacity: int, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the ids of each text and end_id, cut into pieces of capacity."""
    extra = ", ids binary" if with_ids else ""
    kind = df.schema[key].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                at, cols = [], ([], [], [], [], [])
                for i, ids in enumerate(encode_texts(batch.column(1).to_pylist(), path)):
                    ids += end
                    for p, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        at.append(i)
                        for c, x in zip(cols, (p, start // 4, len(part) // 4, zlib.crc32(part), part)):
                            c.append(x)
                made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))][: 5 if with_ids else 4]
                names = ["piece", "start", "length", "ids_crc32", "ids"][: len(made)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *made], [key, *names])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long{extra}")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """{index: copies} of the most valuable multiset of sizes (rising) within capacity, by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    for c in range(int(sizes[0]), capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        gain = best[c - sizes[:k]] + values[:k]
        j = int(gain.argmax())
        best[c], pick[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
    out: Counter = Counter()
    c = capacity
    while c > 0:
        j = int(pick[c])
        out[j] += j >= 0
        c -= int(sizes[j]) if j >= 0 else 1
    return {j: n for j, n in sorted(out.items()) if n}


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, step: float = 0.02, eta: float = 30.0, max_rounds: int = 20_000) -> list[tuple[dict[int, int], float]]:
    """Configurations ({index: copies}) and multiplicities that cover counts with nearly the fewest sequences.

    Multiplicative weights: the price of a size is exp(-eta * its share covered) per occurrence; each round adds a little
    of the configuration that is worth most, until all sizes are covered. Over-covered sizes cost nothing more.
    """
    covered = np.zeros(len(sizes))
    found: dict[tuple, float] = {}
    for _ in range(max_rounds):
        low = covered.min()
        if low >= 1:
            break
        best = knapsack(sizes, np.exp(-eta * (covered - low)) / counts, capacity)
        most = step * min(counts[j] / n for j, n in best.items())
        for j, n in best.items():
            covered[j] += most * n / counts[j]
        found[tuple(best.items())] = found.get(tuple(best.items()), 0.0) + most
    scale = 1 / max(covered.min(), step)
    return sorted(((dict(c), x * scale) for c, x in found.items()), key=lambda f: (-f[1], sorted(f[0].items())))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)]; every length of the histogram is used exactly as often as it occurs.

    Shares of the fractional multiplicities are rounded down and held to what is left; lengths left and short ones go into the
    gaps by best fit, largest first. Of the shares ROUNDED, the one with the fewest sequences counts.
    The plan's size depends on the number of lengths, not on that of rows.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length is out of range")
    out = [([capacity], left.pop(capacity))] if capacity in left else []
    width = -(-capacity // UNITS)
    classes: Counter = Counter()
    for n, c in left.items():
        if n > SAND * width:
            classes[-(-n // width)] += c
    found: list[tuple[dict[int, int], float]] = []
    if sum(classes.values()) > 1:
        sizes = np.array(sorted(classes), np.int64)
        solved = fractional(sizes, np.array([classes[n] for n in sizes.tolist()], np.float64), capacity // width)
        found = [({int(sizes[j]): n for j, n in c.items()}, x) for c, x in solved]
    tried = [_rounded(dict(left), found, share, capacity, width) for share in (ROUNDED if found else (0.0,))]
    return out + min(tried, key=lambda t: sum(times for _, times in t))


def _rounded(left: dict[int, int], found: list[tuple[dict[int, int], float]], share: float, capacity: int, width: int) -> list[tuple[list[int], int]]:
    bins: dict[int, Counter] = {}  # room -> contents -> number of equal sequences
    stock: dict[int, list[int]] = {}  # class -> lengths left, the largest last
    for n in sorted(left):
        stock.setdefault(-(-n // width), []).append(n)

    def draw(config: dict[int, int]) -> Counter | None:
        """The largest lengths left that fill the configuration's places."""
        items: Counter = Counter()
        for size, places in config.items():
            for n in reversed(stock.get(size, ())):
                items[n] = min(places, left[n])
                places -= items[n]
                if not places:
                    break
            if places:
                return None
        return items

    def put(content: tuple[int, ...], times: int) -> None:
        bins.setdefault(capacity - sum(content), Counter())[content] += times

    for config, x in found:
        times = int(share * x)
        while times > 0 and (items := draw(config)):
            many = min([times, *(left[n] // k for n, k in items.items())])
            put(tuple(sorted(items.elements(), reverse=True)), many)
            times -= many
            for n, k in items.items():
                left[n] -= k * many
                if not left[n]:
                    del left[n]
                    stock[-(-n // width)].remove(n)
    for n in sorted(left, reverse=True):
        many = left[n]
        while many:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                each = capacity // n
                if many >= each:
                    put((n,) * each, many // each)
                if many % each:
                    put((n,) * (many % each), 1)
                break
            content, there = next(iter(bins[room].items()))
            each = min(room // n, many)
            times = min(there, many // each)
            bins[room][content] -= times
            if not bins[room][content]:
                del bins[room][content]
                if not bins[room]:
                    del bins[room]
            put(content + (n,) * each, times)
            many -= each * times
    return [(list(content), times) for room in sorted(bins) for content, times in sorted(bins[room].items())]


def slots(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with the sequence of the first of them and the offset in it; sorted by (length, lo)."""
    rank: Counter = Counter()
    rows, base = [], 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], base, offset))
            rank[n] += times
            offset += n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "lo": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 4096, by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with a column length of 1 to capacity) and sequence_id and offset.

    The histogram of lengths (at most capacity rows) goes to the driver, the plan (ranges of ranks per length) to the tasks.
    A piece's rank in its length is numbered in buckets of stored rows, so a length that a third of all pieces
    have is ranked in many tasks. An empty table gives an empty one.
    """
    stored = scratch.cut(pieces)
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    # a place in a written file stays the same when a task runs again, and parts even rows that are equal in all columns
    marked = stored.select(*pieces.columns, F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    marked = marked.withColumn("_b", F.pmod(F.xxhash64("_f", "_r"), F.lit(buckets)))
    sums = marked.groupBy("length", "_b").agg(F.count("*").alias("_s"))
    starts = sums.select("length", "_b", (F.sum("_s").over(W.partitionBy("length").orderBy("_b")) - F.col("_s")).alias("_start"))
    in_bucket = F.row_number().over(W.partitionBy("length", "_b").orderBy(*by, "_f", "_r"))
    ranked = marked.withColumn("_n", in_bucket).join(starts, ["length", "_b"]).withColumn("_rank", F.col("_start") + F.col("_n") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    width = len(pieces.columns)
    at_length = pieces.columns.index("length")
    # (length, lo) as one sorted number: ranks stay under 2^50
    lows = (places["length"].astype(object) * 2**50 + places["lo"].astype(object)).astype(np.int64) if len(places["lo"]) else np.zeros(0, np.int64)
    sequence, lo, offset = places["sequence"], places["lo"], places["offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rank = b.column(width).to_numpy(zero_copy_only=False)
                j = np.searchsorted(lows, b.column(at_length).to_numpy(zero_copy_only=False) * 2**50 + rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(sequence[j] + rank - lo[j]), pa.array(offset[j])], [*b.schema.names[:width], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema_and(pieces, sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, scratch: Scratch, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """token_pieces, packed. Null texts are empty: end_id alone. Other columns are left out."""
    return pack(token_pieces(docs, path, capacity, end_id, key, text), scratch, capacity, (key, "piece"))

"""Line dedup: an exact set-similarity join of lines, ordered by the rarity of their words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, free_names

#: Counters of word frequencies: a table of fixed size, whatever the vocabulary.
COUNTERS = 2**18
SLICE, SLICE_BYTES = 400, 2**20
#: Orders of the words whose least one names groups of classes to settle first.
MINIMA = 3
#: Rows of a bucket, about; lines that hold a word before its rows are dealt to several buckets.
BUCKET, CROWD = 2**18, 2**18
#: Rows that are gathered before they are dealt to buckets, and pairs that are looked at in one go.
GATHER, PAIRS = 2**20, 2**21
#: Counters are summed by so many segments.
SEGMENTS = 16
MARK = "_removed_lines"
SIG = ["sig", "sig2"]


def _word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line of each word, word hash, words per line, lines per text): distinct words of every line."""
    h, counts, per_text = K.split_lines([K.to_bytes(t) for t in texts])
    return *K.distinct_by_unit(counts, h), per_text


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and about so many bytes of text; a longer text is one of its own."""
    for whole in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            to = min(max(fits, at + 1), at + rows)
            yield whole.slice(at, to - at)
            at = to


class LineJoin:
    """Lines that come after a similar line: Jaccard similarity of the sets of words at least num / den.

    Lines are what newlines part, in the order of (key, line number); words are lower-cased between blanks. Lines of
    fewer than min_words different words are neither removed nor compared. Lines with one set of words are one class
    (a 128-bit signature); its first line stands for it, its later lines are copies. A first line is removed if an earlier
    first line is similar (whether or not that one is removed itself). Rows that repeat a key are ordered by a hash of their texts.

    Words are ordered by rarity: by counters of hashed words over all lines' words (a table of COUNTERS numbers), then by hash; any
    total order gives the same result. Similar sets share a word of their prefixes. Candidates agree on such a word, pass the
    length filter and the positional one (words before the first shared one are differences), then a sketch of 128 parities (the
    places where two sketches differ are at most as many as the words that do), and are verified on whole sets.
    First, classes that share the least hash of their words, in one of MINIMA orders, are compared with the earliest of them only; those
    found similar are settled, and all others are compared with every class that shares a word. So a group of near copies costs its size.

    A class and a word of its prefix (or a least hash) are a row of 36 bytes. Rows go to buckets by a hash of the word, packed, many in one
    row of Spark's, and meet there by arrays; a bucket's rows are in memory at once. A word that more than crowd lines hold would fill its
    bucket: its classes fall into parts, and each two parts have a bucket of their own.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, num: int = 8, den: int = 10, min_words: int = 5, key: str = "doc_id", text: str = "text", crowd: int = CROWD):
        if not 0 < num <= den or min_words < 1:
            raise ValueError("threshold in (0, 1], at least one word")
        self.docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
        self.scratch, self.num, self.den, self.min_words, self.crowd = scratch, num, den, min_words, crowd
        self.kind = docs.schema[key].dataType.simpleString()

    def occurrences(self) -> DataFrame:
        """(k, h, line, sig, sig2) of the lines that count. Rows with counters have at, the segment, and count, its packed numbers."""
        least = self.min_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(COUNTERS, np.int64)
            empty = None
            for b in slices(batches):
                unit, words, n, per_text = _word_sets(b.column(1).to_pylist())
                total += np.bincount((words >> K.U(46)).astype(np.int64), minlength=COUNTERS)
                doc = np.repeat(np.arange(len(per_text)), per_text)
                line = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                at = np.flatnonzero(n >= least)
                none = [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())]
                empty = b.column(0).slice(0, 0)
                where = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(2).take(where), pa.array(line[at], pa.int32()), *[pa.array(x[at]) for x in _signatures(unit, words, n)], *none], names)
            if empty is not None:
                none = [pa.nulls(SEGMENTS, t) for t in (empty.type, pa.int64(), pa.int32(), pa.int64(), pa.int64())]
                packed = [_pack([part]) for part in np.split(total, SEGMENTS)]
                yield pa.RecordBatch.from_arrays([*none, pa.array(range(SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], names)

        names = ["k", "h", "line", "sig", "sig2", "at", "count"]
        return self.scratch.cut(self.docs.mapInArrow(run, f"k {self.kind}, h long, line int, sig long, sig2 long, at int, count binary"))

    def _counters(self, every: DataFrame) -> np.ndarray:
        """The counters of all tasks, summed segment by segment."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for at, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    (part,) = _unpack(packed, [np.dtype(np.int64)])
                    total[at] = total[at] + part if at in total else part
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack([x]) for x in total.values()], pa.binary())], ["at", "count"])

        counters = np.zeros((SEGMENTS, COUNTERS // SEGMENTS), np.int64)
        parts = every.where("at is not null").select("at", "count").repartition("at")
        for r in parts.mapInArrow(run, "at int, count binary").collect():
            counters[r["at"]] = _unpack(r["count"], [np.dtype(np.int64)])[0]
        return counters.reshape(-1)

    def _prefixes(self, counters: np.ndarray) -> DataFrame:
        """(sig, sig2, n, prefix, minima, even, odd): the first words of every class by rarity, and its parities; a row for each slice that holds the class."""
        least, num, den = self.min_words, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a counter's place among the counters takes the place of the bits that chose it: one number that sorts by rarity and tells the word
            place = np.empty(COUNTERS, K.U)
            chosen_by = np.argsort(counters, kind="stable").astype(K.U)
            place[chosen_by] = np.arange(COUNTERS, dtype=K.U)
            rest = K.U(2**46 - 1)
            for b in slices(batches):
                h, counts, _ = K.split_lines([K.to_bytes(t) for t in b.column(1).to_pylist()])
                unit, ranked, n = K.distinct_by_unit(counts, (place[h >> K.U(46)] << K.U(46)) | (h & rest))
                words = (chosen_by[ranked >> K.U(46)] << K.U(46)) | (ranked & rest)
                sig, sig2 = _signatures(unit, words, n)
                order = np.lexsort((sig2, sig))
                new = np.ones(len(n), bool)
                new[1:] = (sig[order[1:]] != sig[order[:-1]]) | (sig2[order[1:]] != sig2[order[:-1]])
                once = np.zeros(len(n), bool)
                once[order[new]] = True
                take = once & (n >= least)
                unit, words = unit[take[unit]], words[take[unit]]
                even, odd = _parities(unit, words, len(n))
                heads = np.cumsum(n[take]) - n[take]
                minima = [np.minimum.reduceat(K.mix(words ^ K.U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))), heads) if len(heads) else words for i in range(MINIMA)]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(minima, 1).reshape(-1).view(np.int64)), MINIMA).cast(pa.list_(pa.int64()))
                size = np.where(take, n, 0)
                pos = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
                most = n - (n * num + den - 1) // den + 1
                ends = np.concatenate([[0], np.cumsum(most[take])])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[pos < most[unit]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig[take]), pa.array(sig2[take]), pa.array(n[take], pa.int32()), prefix, lists, pa.array(even[take].view(np.int64)), pa.array(odd[take].view(np.int64))], ["sig", "sig2", "n", "prefix", "minima", "even", "odd"])

        return self.docs.mapInArrow(run, "sig long, sig2 long, n int, prefix array<long>, minima array<long>, even long, odd long")

    def _classes(self, seen: DataFrame, counters: np.ndarray) -> DataFrame:
        """(num, sig, sig2, n, prefix, minima, even, odd, first): every class once; num rises with its first line's place."""
        place = F.struct(F.col("k").isNull().alias("none"), "k", "h", "line")
        firsts, path = self.scratch.table(seen.groupBy(*SIG).agg(F.min(place).alias("first")).orderBy("first").withColumn("num", F.monotonically_increasing_id()))
        once = self._prefixes(counters).dropDuplicates(SIG)
        classes = self.scratch.cut(once.join(firsts, SIG))
        self.scratch.drop(path)
        return classes

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(num, words) of the classes wanted (num; first: the place of a line that is one)."""
        lines = wanted.groupBy(F.col("first.k").alias("k2"), F.col("first.h").alias("h2")).agg(F.collect_list(F.struct("first.line", "num")).alias("c"))
        told = lines.select("k2", "h2", F.col("c.line").alias("lines"), F.col("c.num").alias("nums"))
        rows = self.docs.join(told, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))).select("t", "lines", "nums")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 0):
                chosen: list[bytes] = []
                for t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    every = K.to_bytes(t).split(b"\n")
                    chosen += [every[i] for i in at]
                h, counts = K.split_units(chosen)
                _, words, n = K.distinct_by_unit(counts, h)
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([pc.list_flatten(b.column(2)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.view(np.int64)))], ["num", "words"])

        # rows that repeat a key and a text give a class again
        return rows.mapInArrow(run, "num long, words array<long>").dropDuplicates(["num"])

    def _verify(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """num of pairs (a, num) whose whole sets are similar."""
        pairs, path = self.scratch.table(pairs.distinct())
        both = pairs.select("num").unionAll(pairs.select(F.col("a").alias("num"))).distinct()
        sets, sets_path = self.scratch.table(self._sets(both.join(classes.select("num", "first"), "num")))
        joined = pairs.join(sets, "num").join(sets.select(F.col("num").alias("a"), F.col("words").alias("words_a")), "a")
        o = F.size(F.array_intersect("words", "words_a"))
        found = self.scratch.cut(joined.where(o * self.den >= (F.size("words") + F.size("words_a") - o) * self.num).select("num").distinct())
        self.scratch.drop(path)
        self.scratch.drop(sets_path)
        return found

    def _met(self, rows: DataFrame, rows_at_most: int, keys: Callable, meet: Callable) -> DataFrame:
        """(a, num), num of the earlier class first, of what meet finds in each bucket of rows (num, size, even, odd, words).

        keys tells from (num, words, classes' places of the words), in one piece or more, places among the words and their 64-bit names; classes of one name meet.
        size is 2 n, and 1 more for a settled class.
        """
        buckets = max(-(-rows_at_most // BUCKET), 4 * int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, size = [], 0
            for b in batches:
                gathered.append(b)
                size += len(pc.list_flatten(b.column(4)))
                if size >= GATHER:
                    yield from packed(gathered)
                    gathered, size = [], 0
            if gathered:
                yield from packed(gathered)

        def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(batches).combine_chunks()
            num, size, even, odd = (whole.column(i).to_numpy() for i in range(4))
            count = pc.list_value_length(whole.column(4)).to_numpy().astype(np.int64)
            words = pc.list_flatten(whole.column(4)).to_numpy().view(K.U)
            of = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            for at, names in keys(num, words, of):
                to = ((names >> K.U(32)) * K.U(buckets)) >> K.U(32)
                order = np.argsort(to.astype(np.uint16 if buckets < 2**16 else np.uint32), kind="stable")
                at, names, to = at[order], names[order], to[order]
                who = of[at]
                columns = [x.astype(t, copy=False) for x, t in zip((names & K.U(2**32 - 1), num[who], size[who], pos[at], even[who], odd[who]), ROW)]
                starts = np.flatnonzero(np.concatenate([[len(to) > 0], to[1:] != to[:-1]]))
                blobs = [_pack([c[x:y] for c in columns]) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(to)])]
                yield pa.RecordBatch.from_arrays([pa.array(to[starts].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if bucket != now:
                        yield from met(held)
                        now, held = bucket, []
                    held.append(blob)
            yield from met(held)

        def met(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            if held:
                for x, y in meet([np.concatenate(c) for c in zip(*(_unpack(blob, ROW) for blob in held))]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "num"])

        dealt = rows.mapInArrow(deal, "bucket long, rows binary").repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(run, "a long, num long")

    def _earliest_first(self, classes: DataFrame) -> DataFrame:
        """num of classes that are similar to the earliest class with one of their least word hashes.

        Similar sets share such a hash with a chance of num / den for each of MINIMA orders, so a group of near copies is
        settled but for a few, which the join finds; a class takes part in MINIMA comparisons, however large its group.
        """
        num, den = self.num, self.den
        rows = classes.select("num", (F.col("n") * 2).alias("size"), "even", "odd", "minima")
        pairs = self._met(rows, MINIMA * classes.count(), lambda _, words, of: [(np.arange(len(of)), K.mix(words))], lambda rows: _with_earliest(rows, num, den))
        return self._verify(pairs, classes)

    def removed(self) -> DataFrame:
        """(k, h, line) of the lines that go."""
        every = self.occurrences()
        seen = every.where("sig is not null").select("k", "h", "line", *SIG)
        counters = self._counters(every)
        classes = self._classes(seen, counters)
        gone = self._earliest_first(classes)
        num, den, crowd = self.num, self.den, self.crowd
        # settled classes stay, as others may be similar to them
        flagged = classes.join(gone.withColumn("gone", F.lit(1)), "num", "left")
        rows = flagged.select("num", (F.col("n") * 2 + F.coalesce("gone", F.lit(0))).alias("size"), "even", "odd", "prefix")
        most = int(counters.sum()) * (den - num) // den + classes.count()
        later = self._verify(self._met(rows, most, lambda *x: _in_crowds(*x, counters, crowd), lambda rows: _similar_sketches(rows, num, den)), classes)
        near = gone.unionAll(later).withColumn("near", F.lit(True))
        told = classes.select("num", *SIG, "first").join(near, "num", "left")
        place = F.struct(F.col("k").isNull().alias("none"), "k", "h", "line")
        return seen.join(told, SIG).where(F.col("near") | (place != F.col("first"))).select("k", "h", "line")


#: A row in a bucket: name of a word (32 bits; the bucket has the others), num, size, place of the word, sketches.
ROW = [np.dtype(t) for t in ("u4", "i8", "i4", "i4", "u8", "u8")]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte by byte of their numbers, so that bytes that hardly change lie together."""
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def _unpack(packed: bytes, types: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = len(packed) // sum(t.itemsize for t in types), 0, []
    for t in types:
        part = np.frombuffer(packed, np.uint8, n * t.itemsize, at)
        out.append(np.ascontiguousarray(part.reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _in_crowds(num: np.ndarray, words: np.ndarray, of: np.ndarray, counters: np.ndarray, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, names) of words: a word that up to crowd lines hold has one name; others have one for each two parts of their classes."""
    parts = np.maximum(1, -(-counters[(words >> K.U(46)).astype(np.int64)] // crowd))
    upto = np.cumsum(parts)
    done = 0
    while done < len(words):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 2 * GATHER, side="right")))
        at = np.repeat(np.arange(done, to), parts[done:to])
        many = parts[at]
        other = np.arange(len(at)) - np.repeat(upto[done:to] - parts[done:to] - (upto[done - 1] if done else 0), parts[done:to])
        own = (K.mix(num.view(K.U))[of[at]] % many.astype(K.U)).astype(np.int64)
        cell = (np.minimum(own, other).astype(K.U) << K.U(32)) + np.maximum(own, other).astype(K.U)
        yield at, K.mix(words[at] + np.where(many > 1, K.mix(cell + K.U(1)), K.U(0)))
        done = to


def _apart(even: np.ndarray, odd: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of the sketches' places the rows x and y differ (unsigned: numpy counts the bits of absolute values)."""
    return np.bitwise_count(even[x] ^ even[y]).astype(np.int64) + np.bitwise_count(odd[x] ^ odd[y])


def _with_earliest(rows: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(num, num) of the earliest class of each name and of every other whose size and sketches allow that they are similar."""
    name, which, size, _, even, odd = rows
    order = np.lexsort((which, name))
    first = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    x, y = np.repeat(order[first], np.diff([*first, len(order)])), order
    n = (size >> 1).astype(np.int64)
    may = (which[x] != which[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
    x, y = x[may], y[may]
    may = _apart(even, odd, x, y) * (den + num) <= (n[x] + n[y]) * (den - num)
    yield which[x[may]], which[y[may]]


def _similar_sketches(rows: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(num, num) of classes that share a name as their first one and can be similar, where the later one is not settled.

    The shared word stands in the smaller set's own prefix among larger ones: a set of n words shares 2 n num / (num + den) at
    least with a similar one that is no smaller. By name and size, the smaller sets that a set can be similar to are a range.
    """
    n = (rows[2] >> 1).astype(np.int64)
    rank = (rows[0].astype(K.U) << K.U(32)) | n.astype(K.U)
    order = np.argsort(rank)
    rank, n = rank[order], n[order]
    _, which, size, pos, even, odd = (c[order] for c in rows)
    live = (size & 1) == 0
    pos = pos.astype(np.int64)
    inside = pos <= n - (2 * num * n + num + den - 1) // (num + den)
    lowest = (rank & ~K.U(2**32 - 1)) | ((n * num + den - 1) // den).astype(K.U)
    for larger, smaller in ((live, inside), (~live, inside & live)):
        x, y = np.flatnonzero(larger), np.flatnonzero(smaller)
        low, high = np.searchsorted(rank[y], lowest[x]), np.searchsorted(rank[y], rank[x], side="right")
        upto = np.cumsum(high - low)
        at = 0
        while at < len(x):
            done = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            count = (high - low)[at:to]
            i = np.repeat(x[at:to], count)
            j = y[np.arange(len(i)) + np.repeat(low[at:to] - (upto[at:to] - count - done), count)]
            at = to
            total, before = n[i] + n[j], pos[i] + pos[j]
            may = before * (den + num) <= total * (den - num)
            i, j, total = i[may], j[may], total[may]
            may = np.minimum(n[i] - pos[i], n[j] - pos[j]) * (den + num) >= total * num
            i, j, total = i[may], j[may], total[may]
            may = _apart(even, odd, i, j) * (den + num) <= total * (den - num)
            i, j = i[may], j[may]
            # of sets of one size the earlier counts as the smaller; the later one must be open
            may = ((n[j] < n[i]) | (which[j] < which[i])) & np.where(which[j] < which[i], live[i], live[j])
            if may.any():
                yield which[i[may]], which[j[may]]


def _signatures(unit: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two numbers."""
    return tuple(K.mix(K.set_sums(unit, K.mix(w), len(n)) + add).view(np.int64) for w, add in ((words, K.U(0)), (words ^ K.U(0xA5A5A5A5A5A5A5A5), K.U(1))))


def _parities(unit: np.ndarray, words: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each unit; each word turns one bit of one of them."""
    spread = K.mix(words ^ K.U(0xC2B2AE3D27D4EB4F))
    bit = K.U(1) << (spread & K.U(63))
    which = (spread >> K.U(6)) & K.U(1)
    out = np.zeros((2, units), K.U)
    if len(unit):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for i in (0, 1):
            out[i, unit[first]] = np.bitwise_xor.reduceat(np.where(which == i, bit, K.U(0)), first)
    return out[0], out[1]


def removed_line_lists(docs: DataFrame, scratch: Scratch, num: int = 8, den: int = 10, min_words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and the column MARK: numbers (from 0, rising) of the lines that go, null where all stay.

    Of rows that repeat a key and a text, all keep what the first line of a class is. Null keys are one key, after all others; null and
    empty texts and blank lines have no words and are not compared. Other columns stay, whatever their names; one named MARK is replaced.
    """
    steps = Scratch(docs.sparkSession, "line-steps")
    join = LineJoin(docs, steps, num, den, min_words, key, text)
    gone = scratch.cut(join.removed().groupBy("k", "h").agg(F.sort_array(F.collect_set("line")).alias(MARK)))
    steps.clear()
    k, h, hashed = free_names(docs, "k", "h", "hashed")
    told = gone.select(F.col("k").alias(k), F.col("h").alias(h), MARK)
    whole = docs.drop(MARK).withColumn(hashed, F.xxhash64(F.col(f"`{text}`")))
    same = F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(hashed) == F.col(h))
    return whole.join(told, same, "left").drop(k, h, hashed)


def dedup_lines(docs: DataFrame, scratch: Scratch, num: int = 8, den: int = 10, min_words: int = 5, drop_share: float | None = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their later similar lines; a document that loses drop_share of its words or more goes as a whole (None: it stays).

    Null and empty texts have no line that counts and stay as they are; so do other columns.
    """
    marked = removed_line_lists(docs, scratch, num, den, min_words, key, text)
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(MARK), i)), "\n")
    left = F.when(F.col(MARK).isNotNull(), kept).otherwise(F.col(f"`{text}`"))
    (name,) = free_names(marked, "left")
    out = marked.withColumn(name, left)
    if drop_share is not None:
        words = lambda t: F.size(F.filter(F.split(F.col(f"`{t}`"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        out = out.where(~(F.col(MARK).isNotNull() & (words(name) <= words(text) * (1 - drop_share))))
    return out.select(*[F.col(f"`{name}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != MARK])

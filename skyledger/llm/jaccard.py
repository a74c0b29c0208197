"""N-gram Jaccard join: the global n-gram order cut into fragments, partial overlaps counted apart and summed per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .components import connected_components
from .scratch import Scratch

SLICE = 400
#: Fragments in which the overlaps of a candidate pair are counted apart.
PARTS = 4
STAR_ROUNDS = 1
#: Times that classes in too few mixed buckets are taken out, and buckets that are not mixed then.
THINNED = 2
#: The keys are dealt to so many rounds by their hashes, one after another: their shuffles are on disk one round at a time.
KEY_ROUNDS = 4


def _lists(unit: np.ndarray, values: np.ndarray, units: int) -> pa.Array:
    order = np.argsort(unit, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=units))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order].view(np.int64)))


def _sig_array(sig: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = sig.astype("<u8").tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts.tolist())], pa.binary())


def _pieces(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def shingle_keys(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(key, n, sig, u, common, keys0, keys1, ...): set size, 128-bit signature of the set (null if empty), its first half, how many keys it shares with a similar set at least, and the fragment keys by round."""
    rounds = [f"keys{r}" for r in range(KEY_ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = K.Fragments(num, den)
        for batch in _pieces(batches):
            unit, values, counts = K.shingle_sets([K.to_bytes(x) for x in batch.column(1).to_pylist()], words)
            halves = K.signatures(unit, values, len(counts))
            of, made, common = cuts.keys(unit, values, counts)
            turn = made % K.U(KEY_ROUNDS)
            lists = [_lists(of[turn == r], made[turn == r], len(counts)) for r in range(KEY_ROUNDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), _sig_array(halves, counts), pa.array(halves[:, 0].view(np.int64)), pa.array(common, pa.int32()), *lists], [key, "n", "sig", "u", "common", *rounds])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n long, sig binary, u long, common int, " + ", ".join(f"{r} array<long>" for r in rounds))


def shingle_parts(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(sig, part, grams): the shingles of each document in each fragment of the global order, empty ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            unit, values, counts = K.shingle_sets([K.to_bytes(x) for x in batch.column(1).to_pylist()], words)
            sigs = _sig_array(K.signatures(unit, values, len(counts)), counts)
            part = unit * PARTS + (values >> K.U(62)).astype(np.int64)
            used = np.unique(part)
            grams = _lists(np.searchsorted(used, part), values, len(used))
            yield pa.RecordBatch.from_arrays([sigs.take(pa.array(used // PARTS)), pa.array(used % PARTS, pa.int32()), grams], ["sig", "part", "grams"])

    return docs.select(key, text).mapInArrow(run, "sig binary, part int, grams array<long>")


class JaccardJoin:
    """Documents whose sets of n-word shingles have Jaccard similarity num / den or more, as connected groups.

    1. Documents with one set form a class (a 128-bit signature); only classes are compared.
    2. The hash order of all shingles is cut into fragments, so many that two similar sets must agree on one
       (kernels.Fragments); classes that agree on a fragment are candidates. No class without a partner is compared.
    3. In each such bucket a pivot is compared with every other class; the overlap of a pair is counted in each of
       PARTS fragments apart and summed per pair. Links make components.
    4. Buckets whose classes are all in one component are done: more links there would change nothing. A class in
       fewer of the other buckets than it shares with any similar set has no link left to find.
       In the other buckets, what is still in different components is compared with another pivot, and at last by pairs that
       share a shingle in their prefixes, in rising order of the shingles' frequency among the classes left (a pair
       that links must). So every pair that could join two components is compared, while shared passages
       and groups of near copies, whose classes differ by shingles of their own, cost their size and not its square.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, words: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text"):
        if not 0 < num <= den:
            raise ValueError("the threshold lies in (0, 1]")
        self.docs, self.scratch, self.words, self.num, self.den, self.key, self.text = docs.select(key, text), scratch, words, num, den, key, text
        self.base, self.base_path = scratch.table(shingle_keys(self.docs, key, text, words, num, den))

    def members(self) -> DataFrame:
        """(k, sig, n, common) of buckets with two classes or more, without classes in too few of them to have a link.

        Keys go with half a signature first; classes that share a half come together again where the whole one is joined.
        Two similar classes that share a half (one in 2^64) could miss each other in a bucket of no third class.
        """
        found = []
        for r in range(KEY_ROUNDS):
            keyed = self.base.where("n > 0").select(F.explode(f"keys{r}").alias("k"), "u")
            shared = keyed.groupBy("k").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo <> hi").select("k")
            found.append(self.scratch.table(keyed.join(shared.hint("shuffle_hash"), "k").distinct()))
        every = found[0][0]
        for more, _ in found[1:]:
            every = every.unionAll(more)
        # without the classes that too few shared keys are left to
        halves = self.base.where("n > 0").select("u", "common").groupBy("u").agg(F.min("common").alias("common"))
        able = every.groupBy("u").agg(F.count("*").alias("m")).join(halves, "u").where("m >= common").select("u")
        classes = self.base.where("n > 0").select("u", "sig", F.col("n").cast("int").alias("n"), "common").distinct().join(able, "u", "left_semi")
        members = self.scratch.cut(every.join(classes, "u").select("k", "sig", "n", "common"))
        kept, base_path = self.scratch.table(self.base.select(self.key, "n", "sig"))
        for path in (self.base_path, *[path for _, path in found]):
            self.scratch.drop(path)
        self.base, self.base_path = kept, base_path
        return members

    def parts(self, members: DataFrame) -> DataFrame:
        wanted = self.scratch.cut(members.select("sig").distinct())
        ids = self.base.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min(self.key).alias("_id")).select("_id").distinct()
        # by shuffle at every size: the keys grow with the documents
        chosen = self.docs.join(ids.hint("merge"), F.col(self.key).eqNullSafe(F.col("_id")), "left_semi")
        found = shingle_parts(chosen, self.key, self.text, self.words).join(wanted, "sig", "left_semi")
        return self.scratch.cut(found.dropDuplicates(["sig", "part"]))

    def similar_size(self, a: str, b: str):
        small, large = F.least(a, b), F.greatest(a, b)
        return small * self.den >= large * self.num

    def verify(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """(u, v) of pairs (u, v, nu, nv) whose overlaps over all fragments sum to enough; one fragment at a time, so that one's shingles are on disk."""
        pairs, path = self.scratch.table(pairs)
        found = []
        for p in range(PARTS):
            part = parts.where(F.col("part") == p)
            left = pairs.select("u", "v").join(part.select(F.col("sig").alias("u"), F.col("grams").alias("gu")), "u")
            both = left.join(part.select(F.col("sig").alias("v"), F.col("grams").alias("gv")), "v")
            o = F.size(F.array_intersect("gu", "gv")).cast("long")
            found.append(self.scratch.table(both.select("u", "v", o.alias("o")).where("o > 0")))
        every = found[0][0]
        for more, _ in found[1:]:
            every = every.unionAll(more)
        total = every.groupBy("u", "v").agg(F.sum("o").alias("o")).join(pairs, ["u", "v"])
        links = self.scratch.cut(total.where(F.col("o") * self.den >= (F.col("nu") + F.col("nv") - F.col("o")) * self.num).select("u", "v"))
        for x in (path, *[x for _, x in found]):
            self.scratch.drop(x)
        return links

    def prefix_pairs(self, classes: DataFrame, parts: DataFrame) -> DataFrame:
        """(sig, n, c, sig2, n2, c2) of classes (sig, n, c) of two components that share one of their rarest shingles.

        As many of them as similar sets must share one of, in the order of (classes that have it, hash); shingles of one class only come first and
        are counted, not compared. One fragment of the shingles is counted at a time, and classes go by number, so that little is on disk.
        """
        named, named_path = self.scratch.table(classes.withColumns({"num": F.monotonically_increasing_id(), "of": F.xxhash64("c")}))
        ids, found = named.select("sig", "num"), []
        for p in range(PARTS):
            rows = parts.where(F.col("part") == p).join(ids, "sig").select("num", F.explode("grams").alias("g"))
            shared = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
            found.append(self.scratch.table(rows.join(shared.hint("shuffle_hash"), "g").select("num", "g", F.col("df").cast("int").alias("df"))))
        common = found[0][0]
        for more, _ in found[1:]:
            common = common.unionAll(more)
        sized = common.join(named.select("num", "of", F.col("n").cast("int").alias("n")), "num")
        by = W.partitionBy("num")
        ranked = sized.withColumn("pos", F.col("n") - F.count("*").over(by).cast("int") + F.row_number().over(by.orderBy("df", "g")) - 1)
        needed = F.floor((F.col("n") * self.num + self.den - 1) / self.den)
        prefix, prefix_path = self.scratch.table(ranked.where(F.col("pos") <= F.col("n") - needed).select("g", "num", "of", "n", "pos"))
        for _, path in found:
            self.scratch.drop(path)
        x, y = prefix.alias("x"), prefix.alias("y")
        n, n2, pos, pos2 = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos"))
        # before the first shingle that two sets share, every shingle of either is a difference
        differ = (pos + pos2) * (self.den + self.num) <= (n + n2) * (self.den - self.num)
        left = F.least(n - pos, n2 - pos2) * (self.den + self.num) >= (n + n2) * self.num
        size = F.least(n, n2) * self.den >= F.greatest(n, n2) * self.num
        # classes of one component meet no more, so that a group of near copies makes no pairs here
        apart = (F.col("x.num") < F.col("y.num")) & (F.col("x.of") != F.col("y.of"))
        met = x.join(y, (F.col("x.g") == F.col("y.g")) & apart & differ & left & size)
        pairs, path = self.scratch.table(met.select(F.col("x.num").alias("num"), F.col("y.num").alias("num2")).distinct())
        other = named.select(*[F.col(c).alias(f"{c}2") for c in named.columns])
        out = self.scratch.cut(pairs.join(named, "num").join(other, "num2").drop("num", "num2", "of", "of2"))
        for x in (path, prefix_path, named_path):
            self.scratch.drop(x)
        return out

    def classes(self) -> DataFrame | None:
        """(node, component) of the classes that have a link; None if no two classes share a fragment."""
        members = self.members()
        if members.isEmpty():
            return None
        parts = self.parts(members)
        weights = members.groupBy("sig").agg(F.count("*").alias("w"))
        label, links = None, None
        for turn in range(STAR_ROUNDS + 1):
            now = members.withColumn("c", F.col("sig"))
            if label is not None:
                now = members.join(label, F.col("sig") == F.col("node"), "left").select("k", "sig", "n", "common", F.coalesce("component", "sig").alias("c"))
                now, path = self.scratch.table(now)
                for _ in range(THINNED):
                    mixed = now.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k")
                    open_ = now.join(mixed, "k", "left_semi")
                    able = open_.groupBy("sig").agg(F.count("*").alias("m"), F.min("common").alias("least")).where("m >= least").select("sig")
                    thinner, new_path = self.scratch.table(open_.join(able, "sig", "left_semi"))
                    self.scratch.drop(path)
                    now, path = thinner, new_path
                if now.isEmpty():
                    break
            other = [F.col(x).alias(f"{x}2") for x in ("sig", "n", "c")]
            if turn < STAR_ROUNDS:
                # first the class that shares most fragments (the origin of copies), then any
                rank = F.col("w") if turn == 0 else F.xxhash64("sig", F.lit(turn))
                best = F.max(F.struct(rank.alias("h"), "sig", "n", "c")).alias("p")
                pivot = now.join(weights, "sig").groupBy("k").agg(best).select("k", "p.sig", "p.n", "p.c")
                paired = now.join(pivot.select("k", *other), "k").where("c <> c2")
            else:
                paired = self.prefix_pairs(now.select("sig", "n", "c").distinct(), parts)
            paired = paired.where(self.similar_size("n", "n2"))
            first = F.col("sig") < F.col("sig2")
            named = {"u": ("sig", "sig2"), "v": ("sig2", "sig"), "nu": ("n", "n2"), "nv": ("n2", "n")}
            pairs = paired.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for z, (x, y) in named.items()])
            found = self.verify(pairs.distinct(), parts)
            links = found if links is None else links.unionAll(found)
            label = connected_components(links, self.scratch)
        return self.scratch.cut(label)

    def least(self) -> DataFrame:
        """(sig, least): every class and the least key that its links reach."""
        label = self.classes()
        own = self.base.where("sig is not null").groupBy("sig").agg(F.min(self.key).alias("least"))
        if label is None:
            return self.scratch.cut(own)
        linked = own.join(label, F.col("sig") == F.col("node"))
        least = linked.groupBy("component").agg(F.min("least").alias("of_all"))
        told = label.join(least, "component").select(F.col("node").alias("sig"), "of_all")
        return self.scratch.cut(own.join(told, "sig", "left").select("sig", F.coalesce("of_all", "least").alias("least")))

    def groups(self) -> DataFrame:
        """(key, n_shingles, component_id) for every row of docs: component_id is the least key that links reach.

        Null and blank texts have an empty set, no link and their own key; a null key is never the least of others.
        Repeated rows stay, each with the same component.
        """
        least = self.least()
        rows = self.base.select(self.key, "n", "sig")
        # both sides are written tables, so that Spark can split the rows of a text that many share
        linked = rows.where("n > 0").join(least, "sig").select(self.key, "n", "least")
        empty = rows.where("n = 0").select(self.key, "n", F.col(self.key).alias("least"))
        return linked.unionAll(empty).select(self.key, F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def jaccard_groups(docs: DataFrame, scratch: Scratch, words: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """JaccardJoin(...).groups()"""
    return JaccardJoin(docs, scratch, words, num, den, key, text).groups()


def keep_one_of_each_group(docs: DataFrame, scratch: Scratch, words: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of similar rows: that of the least key, null keys last, then of the least checksum of the text.

    Rows are grouped by their texts, whatever their keys: rows that repeat a key, or have none, are one group only if
    links join their texts. Rows with an empty set are in no group and all stay.
    """
    # a row's key and a 128-bit checksum of its text: rows that share it have one text, so one group
    place = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("k"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
    steps = Scratch(docs.sparkSession, "copies-steps")
    join = JaccardJoin(docs.select(place.alias("place"), F.col(f"`{text}`").alias("text")), steps, words, num, den, "place", "text")
    heads = scratch.cut(join.least().select(F.col("least").alias("head")).distinct())
    steps.clear()
    empty = F.trim(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    rows = docs.where(~empty).select(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = rows.join(heads, F.col("place") == F.col("head"), "left_semi").groupBy("place").agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(docs.where(empty))

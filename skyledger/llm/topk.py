"""Exact top-k search by inner product: MaxScore over postings of signed integer components, in shards that are merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

#: Rows of a shard of postings, queries of a block.
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096
#: Whole numbers up to here are exact in floating point, and in longs.
EXACT, LONG = 2**53, 2**63


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double, as whole doubles; null for null vectors and those with null, infinite or NaN components.

    A component so large that scale * x is infinite makes the vector null too: there is no whole number for it.
    """
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # the function floor gives longs; what lies beyond 2^53 is whole as it is
    floor = F.transform(x, lambda v: F.when(F.abs(v) < float(EXACT), F.floor(v).cast("double")).otherwise(v))
    return F.when(vector.isNotNull() & ~bad, floor)


def _whole(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of width components: doubles, or Python's integers where one is 2^53 or more."""
    out = np.zeros((len(vectors), width))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v[:width]
    if np.abs(out).max(initial=0) < EXACT:
        return out
    return np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(len(vectors), width)


class Postings:
    """Inverted lists of one shard: for each term (a dimension and a sign) the rows with such a component, and the largest."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, vectors: list):
        order = np.argsort(ids, kind="stable")
        self.names, self.ids = names[order], ids[order]
        self.dense = _whole([vectors[k] for k in order], max((len(v) for v in vectors), default=0))
        self.lists = {}
        for d in range(self.dense.shape[1]):
            col = self.dense[:, d]
            for sign in (1, -1):
                rows = np.flatnonzero(col * sign > 0)
                if len(rows):
                    values = col[rows] * sign
                    self.lists[d, sign] = rows, values, values.max()

    def search(self, own: int, query: list, k: int, floor: int | None) -> tuple[np.ndarray, list[int]]:
        """Places in the shard and scores of rows that can be among the k best with a score of floor or more, by falling score and rising id.

        A query component and a posting of its sign add to a score, one of the other sign takes from it. Terms that add are sorted by
        their bound. The longest run of small bounds that sums to less than the threshold is non-essential: a row in none of
        the other lists scores less. Essential lists are traversed; of the rows met, those whose sum so far and the
        other bounds reach the threshold are probed in the rest. Until a threshold over 0 is known, all rows are candidates.
        Sums are exact: doubles while every partial sum is below 2^53, Python's integers beyond.
        """
        n = min(len(query), self.dense.shape[1])
        whole, dense = [int(q) for q in query[:n]], self.dense
        most = [max((int(self.lists[d, s][2]) for s in (1, -1) if (d, s) in self.lists), default=0) for d in range(n)]
        plain = dense.dtype != object and sum(abs(q) * m for q, m in zip(whole, most)) < EXACT
        kind = np.float64 if plain else object
        if not plain and dense.dtype != object:
            dense = np.array([[int(x) for x in row] for row in dense.tolist()], object).reshape(dense.shape)
        asked = np.array(whole, kind)
        if plain and floor is not None and abs(floor) >= EXACT:  # no sum here is as large
            if floor > 0:
                return np.zeros(0, np.int64), []
            floor = None
        terms = sorted((abs(q) * int(self.lists[d, s][2]), d, s) for d, q in enumerate(whole) if q for s in [1 if q > 0 else -1] if (d, s) in self.lists)
        if floor is None or floor <= 0 or not terms:
            rows = np.arange(len(self.ids))
        else:
            upto = [0]
            for bound, _, _ in terms:
                upto.append(upto[-1] + bound)
            cut = max(i for i in range(len(terms) + 1) if upto[i] < floor)  # terms[:cut] sum to less than floor
            part, met = np.zeros(len(self.ids), kind), np.zeros(len(self.ids), bool)
            for _, d, s in terms[cut:]:
                r = self.lists[d, s][0]
                part[r] += dense[r, d] * asked[d]
                met[r] = True
            rows = np.flatnonzero(met & (part + upto[cut] >= floor))
            part = part[rows]
            for at in range(cut - 1, -1, -1):  # probe the others, the largest bound first, while a row is competitive
                d = terms[at][1]
                part = part + np.maximum(dense[rows, d] * asked[d], 0)
                keep = (part + upto[at] >= floor).astype(bool)
                rows, part = rows[keep], part[keep]
        rows = rows[self.names[rows] != own]
        scores = dense[rows, :n] @ asked if n else np.zeros(len(rows))
        if floor is not None:
            keep = (scores >= floor).astype(bool)
            rows, scores = rows[keep], scores[keep]
        if plain and len(rows) > k:
            kth = np.partition(scores, -k)[-k]
            rows, scores = rows[scores >= kth], scores[scores >= kth]
        best = sorted(range(len(rows)), key=lambda i: (-int(scores[i]), rows[i]))[:k]
        return rows[best], [int(scores[i]) for i in best]


def top_k(rows: DataFrame, asks: Column, scratch: Scratch, k: int = 5, key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, score) of the k rows of highest score for each row where asks holds; ties to the smaller key.

    rows: (key, v), v an array of whole doubles (whole_components) or null. Rows with a null key or v take no part. Every row is a candidate
    of every query but itself: rows that repeat a key are candidates of their own, and queries of their own with one key.
    Missing components of the shorter vector count as 0; an empty vector scores 0. A score beyond the range of longs is
    ranked by its true value and given as the range's end. An empty table gives none.

    Candidates are dealt to shards of about SHARD_ROWS rows by a hash, queries to blocks of BLOCK_QUERIES; a task
    searches one block in one shard. Each query is first searched in one shard; the k-th best score there
    is its threshold in all others. The shards' lists (k rows per query) are merged.
    """
    clean = rows.where(F.col(key).isNotNull() & F.col("v").isNotNull())
    # a number for every row, fixed by writing it
    every = scratch.cut(clean.select(F.monotonically_increasing_id().alias("name"), key, "v", F.coalesce(asks, F.lit(False)).alias("asks")))
    counted = every.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-counted[0] // SHARD_ROWS)), max(1, -(-counted[1] // BLOCK_QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64("name", F.lit(salt)), F.lit(n)).cast("int")
    stored = scratch.cut(every.select("name", key, "v", dealt(shards, 0).alias("shard")))
    asked = every.where("asks").select("name", F.col(key).alias("query_id"), "v", dealt(blocks, 1).alias("block"), dealt(shards, 2).alias("home"))

    def search(_: tuple, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"name": [], "query_id": [], key: [], "score": [], "kth": []}
        if len(c) and len(q):
            index = Postings(c["name"].to_numpy(np.int64), c[key].to_numpy(np.int64), list(c["v"]))
            for name, query_id, vector, kth in zip(q["name"].tolist(), q["query_id"].tolist(), q["v"], q["kth"]):
                found, scores = index.search(name, list(vector), k, None if kth is None else int(kth))
                out["name"] += [name] * len(found)
                out["query_id"] += [query_id] * len(found)
                out[key] += index.ids[found].tolist()
                out["score"] += [str(s) for s in scores]
                out["kth"] += [str(scores[-1]) if len(scores) == k else None] * len(found)
        return pd.DataFrame({c: pd.Series(v, dtype=object if c in ("score", "kth") else np.int64) for c, v in out.items()})

    schema = f"name long, query_id long, `{key}` long, score string, kth string"

    def searched(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, schema)

    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    at_home = asked.select("name", "query_id", "v", F.col("home").alias("shard"), "block", F.lit(None).cast("string").alias("kth"))
    first = scratch.cut(searched(stored.select("name", key, "v", "shard", block), at_home, "shard", "block"))
    known = first.groupBy("name").agg(F.max("kth").alias("kth"))
    away = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("home"))
    told = asked.join(known, "name", "left").select("name", "query_id", "v", F.explode(away).alias("shard"), "block", "kth")
    other = searched(stored.select("name", key, "v", "shard", block), told, "shard", "block")
    score = F.col("score").cast("decimal(38,0)")
    found = first.unionAll(other).withColumns({"far": F.length("score") > 37, "value": F.when(F.length("score") <= 37, score), "sign": F.when(F.startswith("score", F.lit("-")), -1).otherwise(1)})
    # numbers of more than 37 digits: by sign, then by length and digits
    order = [F.desc(F.when(F.col("far"), F.col("sign") * F.length("score")).otherwise(0)), F.desc("value"), F.when(F.col("sign") > 0, F.col("score")).desc(), F.when(F.col("sign") < 0, F.col("score")).asc(), F.col(key)]
    rank = F.row_number().over(W.partitionBy("name").orderBy(*order)).cast("int")
    held = F.when(F.col("far"), F.when(F.col("sign") > 0, LONG - 1).otherwise(-LONG)).otherwise(F.least(F.greatest("value", F.lit(-LONG).cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, held.cast("long").alias("score"))

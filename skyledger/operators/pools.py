"""Pools of historical services: sizes by fallback level, choice, membership, deterministic draws and replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROUTE = ("origin", "destination")
#: Finest first; each level leaves out a field of the one before.
LEVELS: tuple[tuple[str, ...], ...] = (
    ("operating_carrier", "quarter", "weekday", "bucket"),
    ("operating_carrier", "quarter", "bucket"),
    ("operating_carrier", "quarter"),
    ("quarter",),
    (),
)
FIELDS = LEVELS[0]


def level_label(i: int, fields: Sequence[str]) -> str:
    return f"level_{i}:" + ("_".join(fields) or "route_only")


def check_levels(levels: Sequence[Sequence[str]], min_support: int, bucket_hours: int) -> None:
    """Raises unless support is positive, buckets divide a day and levels shrink to the bare route."""
    if min_support < 1 or not 0 < bucket_hours <= 24 or 24 % bucket_hours:
        raise ValueError("support of one at least, buckets that divide a day")
    if not levels or levels[-1] or any(not set(b) < set(a) for a, b in zip(levels, levels[1:])):
        raise ValueError("each level leaves out fields of the one before, down to none")


def fine_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(*ROUTE, *FIELDS).agg(F.count("*").alias("n"))


def level_sizes(fine: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """(level, route, fields, size): the fine counts, summed once per level; fields that a level leaves out are null.

    The scan is aggregated once; the levels re-aggregate that small table. Rows with a null field take no part in levels with it.
    """
    out = None
    for i, fields in enumerate(levels):
        rows = fine.dropna(subset=list(fields)) if fields else fine
        kept = [F.col(f) if f in fields else F.lit(None).cast(fine.schema[f].dataType).alias(f) for f in FIELDS]
        part = rows.select(F.lit(i).alias("level"), *ROUTE, *kept, "n").groupBy("level", *ROUTE, *FIELDS).agg(F.sum("n").alias("size"))
        out = part if out is None else out.unionAll(part)
    return out


def assign_pools(targets: DataFrame, sizes: DataFrame, min_support: int, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """targets with level, size and low_support of the finest pool with support, else of the last one that is not empty; null without any."""
    by_level = [
        F.when(F.lit(True) if not fields else F.coalesce(*[F.lit(False)]) | F.expr(" and ".join(f"{f} is not null" for f in fields)),
               F.struct(F.lit(i).alias("level"), *[(F.col(f) if f in fields else F.lit(None).cast(targets.schema[f].dataType)).alias(f"p_{f}") for f in FIELDS]))
        for i, fields in enumerate(levels)
    ]
    keyed = targets.select("service_id", *ROUTE, F.explode(F.array_compact(F.array(*by_level))).alias("k")).select("service_id", *ROUTE, "k.*")
    same = (keyed["level"] == sizes["level"]) & (keyed["origin"] == sizes["origin"]) & (keyed["destination"] == sizes["destination"])
    for f in FIELDS:
        same = same & keyed[f"p_{f}"].eqNullSafe(sizes[f])
    found = keyed.join(sizes, same).select(keyed["service_id"], keyed["level"], sizes["size"])
    usable = found.where((F.col("size") >= min_support) | (F.col("level") == len(levels) - 1))
    best = usable.groupBy("service_id").agg(F.min(F.struct("level", "size")).alias("b")).select("service_id", "b.*")
    return targets.join(best, "service_id", "left").withColumn("low_support", F.col("size") < min_support)


def coverage_report(assigned: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """Services per level label (unsupported ones apart), with low support among them."""
    label = F.coalesce(*[F.when(F.col("level") == i, level_label(i, f)) for i, f in enumerate(levels)], F.lit("unsupported"))
    return assigned.groupBy(label.alias("level_label")).agg(F.count("*").alias("services"), F.count_if("low_support").alias("low_support"))


def members(history: DataFrame, fields: Sequence[str]) -> DataFrame:
    """history with ordinal: the 0-based place in its pool by service_id."""
    return history.withColumn("ordinal", F.row_number().over(W.partitionBy(*ROUTE, *fields).orderBy("service_id")) - 1)


def membership_hash(history: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(route, fields, size, sha256): SHA-256 of a pool's service ids as a JSON array in order.

    A pool's ids come together in one row: only pools that are drawn from need a hash, so filter history to them first.
    """
    ids = F.array_sort(F.collect_list("service_id"))
    text = F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]'))
    return history.groupBy(*ROUTE, *fields).agg(F.count("*").alias("size"), F.sha2(text, 256).alias("sha256"))


def replay_map(services: DataFrame) -> DataFrame:
    """(service_id, record_id, pool_id) of services: the exact outcome stands for the pool, one member each."""
    return services.select("service_id", "record_id", F.sha2(F.concat(F.lit("exact_replay|"), "service_id"), 256).alias("pool_id"))

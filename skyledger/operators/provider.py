"""Empirical outcomes: a service's pool, a member of it by a seeded draw, and the member's evidence moved to the service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.identity import uniform_index
from .pools import FIELDS, LEVELS, ROUTE


def pool_key(level: Column, fields: Sequence[str] = FIELDS, levels: Sequence[Sequence[str]] = LEVELS) -> list[Column]:
    """The fields that a level keeps, null for those that it leaves out."""
    kept = {f: [i for i, names in enumerate(levels) if f in names] for f in fields}
    return [F.when(level.isin(kept[f]), F.col(f)).alias(f"key_{f}") for f in fields]


def drawn_members(targets: DataFrame, history: DataFrame, seed: Column, version: str, evidence: Sequence[str], levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """targets (service_id, route, FIELDS, level, size) with ordinal and member_<evidence>: the drawn member of each one's pool.

    The ordinal is an unbiased index below the pool's size, from the digest of the seed's receipt. A pool's members are numbered by service_id. Only pools
    that are drawn from are listed, level by level, and only the drawn members are kept before they meet their targets.
    """
    asked = targets.where("level is not null").withColumn("ordinal", uniform_index(seed, F.col("size"), version))
    out = None
    for i, fields in enumerate(levels):
        key = [*ROUTE, *fields]
        own = asked.where(F.col("level") == i)
        wanted = own.select(*key).distinct()
        numbered = history.join(wanted, key, "left_semi").withColumn("_place", F.row_number().over(W.partitionBy(*key).orderBy("service_id")) - 1)
        members = numbered.select(*[F.col(c).alias(f"_{c}") for c in key], "_place", *[F.col(c).alias(f"member_{c}") for c in evidence])
        same = (F.col("ordinal") == F.col("_place")) & (F.lit(True) if not key else F.expr(" and ".join(f"{c} = _{c}" for c in key)))
        part = own.join(members, same).drop("_place", *[f"_{c}" for c in key])
        out = part if out is None else out.unionByName(part)
    return out


def validation_report(assigned: DataFrame, by_request: str = "requests") -> DataFrame:
    """One row: requests, unique services, and the shares of requests that are unsupported, fall back from their carrier, lose the time of day or have low support."""
    total = F.sum(by_request)
    share = lambda when: F.sum(F.when(when, F.col(by_request)).otherwise(0)) / total
    level = F.col("level")
    without = lambda field: [i for i, names in enumerate(LEVELS) if field not in names]
    return assigned.agg(
        total.alias("requests"), F.count_distinct("service_id").alias("services"), share(level.isNull()).alias("unsupported"), share(level.isin(without("operating_carrier"))).alias("carrier_fallback"),
        share(level.isin(without("bucket"))).alias("lost_time_of_day"), share(F.col("low_support")).alias("low_support"), share(F.col("bucket").isNull()).alias("missing_time_bucket"),
    )

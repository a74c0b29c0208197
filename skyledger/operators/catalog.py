"""Services out of marketing rows: exclusion, resolution, conflicts, numbering, support and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import at_minute, bucket_of

KEY = ("flight_date", "operating_carrier", "operating_number", "origin", "destination", "departure_minute")
PLANNED = ("elapsed",)
OBSERVED = ("departure_delay", "cancelled", "diverted")


def outcome_category(cancelled: Column, diverted: Column, reached: Column | None = None) -> Column:
    reached = F.lit(None).cast("boolean") if reached is None else reached
    return (
        F.when(cancelled.isNull() | diverted.isNull() | (cancelled & diverted), "unknown")
        .when(cancelled, "cancelled")
        .when(~diverted, "ordinary")
        .when(reached, "diverted_reached")
        .when(~reached, "diverted_stranded")
        .otherwise("diverted_unknown")
    )


def exclusion_reason(valid_airports: Column, has_identity: Column, has_times: Column, valid: Column) -> Column:
    """The first of the reasons that keep a row out of the schedule; null for a row that is in."""
    failed = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(failed(valid_airports), "invalid_airport_identity")
        .when(failed(has_identity), "missing_service_identity")
        .when(failed(has_times), "unresolved_schedule_time")
        .when(failed(valid), "invalid_schedule")
    )


def with_exclusion(flights: DataFrame) -> DataFrame:
    airports = (F.col("origin") > 0) & (F.col("destination") > 0)
    identity = F.col("operating_carrier").isNotNull() & F.col("operating_number").isNotNull()
    times = F.col("flight_date").isNotNull() & F.col("departure_minute").isNotNull() & F.col("elapsed").isNotNull()
    return flights.withColumn("exclusion", exclusion_reason(airports, identity, times, (F.col("origin") != F.col("destination")) & (F.col("elapsed") > 0)))


def service_id(columns: Sequence[str] = KEY) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def resolve_services(flights: DataFrame, max_group: int = 1000) -> DataFrame:
    """One row per service of rows without an exclusion: its canonical row (least marketing carrier, number and record), size and conflicts.

    Schedule conflict: rows plan different times; evidence conflict: rows report different outcomes. Nulls are values.
    Groups over max_group rows are oversized and make no service (with services = false). All aggregates are partial first.
    """
    planned, observed = F.struct(*PLANNED), F.struct(*OBSERVED)
    first = F.struct("marketing_carrier", "marketing_number", "record_id", *PLANNED, *OBSERVED)
    grouped = flights.where("exclusion is null").groupBy(*KEY).agg(
        F.count("*").alias("rows"), F.min(first).alias("canonical"),
        (F.min(planned) != F.max(planned)).alias("schedule_conflict"), (F.min(observed) != F.max(observed)).alias("evidence_conflict"),
    )
    return grouped.withColumn("oversized", F.col("rows") > max_group).withColumn("service_id", service_id()).select("service_id", *KEY, "rows", "oversized", "schedule_conflict", "evidence_conflict", "canonical.*")


def aliases(flights: DataFrame) -> DataFrame:
    """(alias fields, service_id), each once: the operating and the marketing name under which a departure can be looked up."""
    named = F.explode(F.array(*[F.struct(F.col(f"{k}_carrier").alias("carrier"), F.col(f"{k}_number").alias("number")) for k in ("operating", "marketing")]))
    rows = flights.where("exclusion is null").select("flight_date", "origin", "departure_minute", service_id().alias("service_id"), named.alias("a"))
    return rows.select("flight_date", "origin", "departure_minute", "a.carrier", "a.number", "service_id").where("carrier is not null and number is not null").distinct()


def alias_conflicts(alias: DataFrame) -> DataFrame:
    """Aliases of more than one service; aliases() holds each pair once, so a count tells."""
    return alias.groupBy("flight_date", "origin", "departure_minute", "carrier", "number").agg(F.count("*").alias("services")).where("services > 1")


def conflicting_services(alias: DataFrame) -> DataFrame:
    """service_id of services that share an alias with another one."""
    shared = alias_conflicts(alias).drop("services")
    return alias.join(shared, ["flight_date", "origin", "departure_minute", "carrier", "number"], "left_semi").select("service_id").distinct()


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df and out: row numbers from 1 over (group, order), without one task that sorts all rows.

    Rows are numbered in their groups; a group's offset is a running sum over the table of group sizes.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.sum("_n").over(W.orderBy(*group)) - F.col("_n")).drop("_n")
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.join(offsets, list(group)).withColumn(out, F.col("_offset") + F.col("_rank")).drop("_offset", "_rank")


def ordinal_ranges(df: DataFrame, group: Sequence[str], ordinal: str) -> DataFrame:
    """(group, first, last): runs of consecutive ordinals (gaps and islands)."""
    island = F.col(ordinal) - F.row_number().over(W.partitionBy(*group).orderBy(ordinal))
    runs = df.select(*group, ordinal).distinct().withColumn("_i", island)
    return runs.groupBy(*group, "_i").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last")).drop("_i")


def split_of(year: Column, historical: Sequence[int], evaluation: Sequence[int]) -> Column:
    if set(historical) & set(evaluation):
        raise ValueError("a year is in both splits")
    return F.when(year.isin(*historical), "historical").when(year.isin(*evaluation), "evaluation").otherwise("unassigned")


def pool_features(services: DataFrame, bucket_hours: int = 6) -> DataFrame:
    return services.withColumn("quarter", F.quarter("flight_date")).withColumn("weekday", F.weekday("flight_date")).withColumn("bucket", bucket_of(F.col("departure_minute"), bucket_hours)).withColumn(
        "departure_at", F.unix_seconds(at_minute(F.col("flight_date"), F.col("departure_minute")))
    )

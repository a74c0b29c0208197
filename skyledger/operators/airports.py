"""Airports: a zone for an identity on a day, by reviewed overrides, the IATA table and the US table of local codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a resolution, all texts, and its issues.
RESULT = ("code", "time_zone", "status", "method", "source", "reference_icao", "reference_name", "issues")


def check_overrides(overrides: DataFrame) -> None:
    """Raises if an override lacks a field, ends before it begins, or shares a day of an airport with another one (a reviewed list, of a few rows)."""
    fields = ["airport_id", "code", "time_zone", "source", "valid_from", "valid_to"]
    if not overrides.where(" or ".join(f"{c} is null" for c in fields) + " or valid_from > valid_to").limit(1).isEmpty():
        raise ValueError("an override has an identity, a zone, a source and days in order")
    # of rows in the order of their first days, one that begins before an earlier one has ended overlaps it
    ends = overrides.groupBy("airport_id", "code").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to"))).alias("d"))
    overlap = F.exists(F.sequence(F.lit(1), F.size("d") - 1), lambda i: F.get("d", i)["valid_from"] <= F.get("d", i - 1)["valid_to"])
    if not ends.where(F.size("d") > 1).where(overlap).limit(1).isEmpty():
        raise ValueError("overrides of an airport overlap")


def directory(reference: DataFrame, overrides: DataFrame) -> DataFrame:
    """(code, iata, lid, overrides): all that is known of a code in one row, so that an airport takes one lookup."""
    entry = F.struct("name", "icao", "state", "zone")
    held = F.struct("airport_id", "time_zone", "source", "valid_from", "valid_to")
    codes = reference.select("code", F.when(F.col("kind") == "iata", entry).alias("iata"), F.when((F.col("kind") == "lid") & (F.col("country") == "US"), entry).alias("lid"))
    both = codes.unionByName(overrides.where("source is not null").select("code", held.alias("held")), allowMissingColumns=True)
    return both.groupBy("code").agg(F.first("iata", True).alias("iata"), F.first("lid", True).alias("lid"), F.collect_list("held").alias("overrides"))


def resolve(rows: DataFrame, airport_id: str, code: str, day: str, state: Column | None, reference: DataFrame, overrides: DataFrame, out: str, version: str = "reference") -> DataFrame:
    """rows and out: RESULT for the airport in the columns airport_id and code, on day.

    reference: (kind 'iata' or 'lid', code, country, name, icao, state, zone), a code once for each kind; overrides: (airport_id, code, time_zone, source,
    valid_from, valid_to). An override that holds on the day comes first, then the IATA code, then a local code in the US.
    A state that differs from the reference's is a conflict, a zone that the reference lacks leaves the airport unmapped.
    """
    names = set(rows.columns)
    tag = next(t for t in ("_", "__", "___") if not any(c.startswith(f"{t}{out}") for c in names))
    col = lambda c: F.col(f"{tag}{out}_{c}")
    asked = rows.withColumn(f"{tag}{out}_code", F.upper(F.trim(F.coalesce(F.col(code), F.lit(""))))).withColumn(f"{tag}{out}_state", F.lit(None).cast("string") if state is None else state)
    listed = directory(reference, overrides).select(*[F.col(c).alias(f"{tag}{out}_{n}") for c, n in (("code", "listed"), ("iata", "i"), ("lid", "l"), ("overrides", "held"))])
    # a table of airports is small against flights, of which few codes have most: no shuffle by code
    joined = asked.join(F.broadcast(listed), col("code") == col("listed"), "left")
    valid = F.filter(col("held"), lambda o: (o["airport_id"] == F.col(airport_id)) & F.col(day).between(o["valid_from"], o["valid_to"]))
    joined = joined.withColumn(f"{tag}{out}_o", F.when(F.size(col("held")) > 0, F.get(valid, F.lit(0))))
    own, iata, lid = col("o").isNotNull(), col("i").isNotNull(), col("l").isNotNull()
    pick = lambda c: F.when(iata, col("i")[c]).otherwise(col("l")[c])
    wrong = (col("state") != "") & (F.lower(col("state")) != F.lower(F.coalesce(pick("state"), F.lit(""))))
    status = F.when(own, "resolved").when(~iata & ~lid, "unmapped").when(F.coalesce(wrong, F.lit(False)), "conflict").when(pick("zone").isNull(), "unmapped").otherwise("resolved")
    issue = F.when(own, None).when(~iata & ~lid, "airport_not_in_reference").when(F.coalesce(wrong, F.lit(False)), "state_name_mismatch").when(pick("zone").isNull(), "timezone_not_in_pinned_tzdata")
    found = (
        F.nullif(col("code"), F.lit("")), F.when(own, col("o")["time_zone"]).when(status == "resolved", pick("zone")), status,
        F.when(own, "reviewed_override").when(iata, "exact_iata").when(lid, "exact_us_faa_lid").otherwise("none"),
        F.when(own, col("o")["source"]).otherwise(F.lit(version)), F.when(~own, pick("icao")), F.when(~own, pick("name")),
        F.when(issue.isNull(), F.array().cast("array<string>")).otherwise(F.array(issue)),
    )
    # a struct and no cast of one: where a field is read, the others are not made
    return joined.select(*rows.columns, F.struct(*[c.alias(n) for n, c in zip(RESULT, found)]).alias(out))


def observed(resolved: DataFrame, day: str, *results: tuple[str, str, Column]) -> DataFrame:
    """One row for each distinct resolution (id column, result column, expected state): its first and last day, and how often it was seen."""
    seen = F.explode(F.array(*[F.struct(F.col(i).alias("airport_id"), F.col(r).alias("r"), s.cast("string").alias("expected_state")) for i, r, s in results]))
    return resolved.select(F.col(day).alias("day"), seen.alias("s")).groupBy("s.airport_id", "s.r", "s.expected_state").agg(F.min("day").alias("first_observed_date"), F.max("day").alias("last_observed_date"), F.count("*").alias("occurrences")).select("airport_id", "r.*", "expected_state", "first_observed_date", "last_observed_date", "occurrences")


def zone_sets(rows: DataFrame, airport_id: str, zone: str) -> DataFrame:
    """(airport_id, zones, ambiguous): the zones that an airport was seen with, '' for unresolved; more or fewer than one known zone is ambiguous."""
    zones = F.array_sort(F.collect_set(F.coalesce(F.col(zone), F.lit(""))))
    return rows.groupBy(F.col(airport_id).alias("airport_id")).agg(zones.alias("zones")).withColumn("ambiguous", (F.size("zones") != 1) | F.array_contains("zones", ""))

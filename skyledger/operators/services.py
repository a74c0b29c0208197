"""Services out of normalized flights: identities by canonical digests, conflicts over all planned and observed fields, supports, diagnostics and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest, iso, json_text
from .catalog import exclusion_reason

POLICY = "resolution-v1"
#: The fields in which rows of one service can plan or observe different things.
PLANNED = ("origin", "destination", "scheduled_departure_clock", "scheduled_arrival_clock", "scheduled_elapsed_minutes", "scheduled_departure", "scheduled_arrival")
OBSERVED = (
    "departure_delay_minutes", "arrival_delay_minutes", "actual_elapsed_minutes", "diversion_elapsed_minutes", "diversion_arrival_delay_minutes", "diversion_landings", "taxi_in_minutes", "taxi_out_minutes", "air_time_minutes",
    "cancelled", "diverted", "diversion_reached_destination", "cancellation_code", "actual_departure_clock", "actual_arrival_clock", "actual_departure", "actual_arrival", "outcome_category", "endpoint_airport_id", "endpoint",
    "endpoint_status", "stops",
)
ALIASES = ("operating", "marketing", "originally_scheduled")


def _array(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def service_digest(policy: str, day: Column, carrier: Column, number: Column, origin: Column, destination: Column, departure: Column) -> Column:
    """Digest of [policy, [date, carrier, number, origin id, destination id, scheduled departure]] as canonical JSON."""
    key = _array(json_text(day.cast("string")), json_text(carrier), json_text(number), _number(origin), _number(destination), json_text(iso(departure)))
    return digest(_array(json_text(F.lit(policy)), key))


def alias_digest(day: Column, origin: Column, departure: Column, carrier: Column, number: Column) -> Column:
    """Digest of [date, origin id, scheduled departure, carrier, number]: a name at an airport; the destination is no part of it."""
    return digest(_array(json_text(day.cast("string")), _number(origin), json_text(iso(departure)), json_text(carrier), json_text(number)))


def pool_digest(catalog: str, inventory: str, policy: str, level: Column, key: Column) -> Column:
    """Digest of [catalog, inventory, policy, level, key]; key: a pool's criteria as canonical JSON."""
    return digest(_array(*[json_text(F.lit(x)) for x in (catalog, inventory, policy)], _number(level), key))


def scenario_digest(scenario: Column, seed: Column, version: str) -> Column:
    """Digest of a scenario's canonical JSON, keys in order."""
    return digest(F.concat(F.lit('{"sampler_version":'), json_text(F.lit(version)), F.lit(',"scenario_id":'), json_text(scenario), F.lit(',"seed":'), _number(seed), F.lit("}")))


def receipt(**parts: Column) -> Column:
    """What a draw was made from, as canonical JSON: keys in order, numbers and texts as they are (texts as JSON already)."""
    pairs = [F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def stored_id(hexadecimal: Column) -> Column:
    return F.unhex(hexadecimal)


def public_id(stored: Column) -> Column:
    return F.lower(F.hex(stored))


def candidates(flights: DataFrame, policy: str = POLICY) -> DataFrame:
    """flights with exclusion (null: schedulable) and the service's id."""
    return with_id(excluded(flights), policy)


def excluded(flights: DataFrame) -> DataFrame:
    """flights with exclusion, the reason why a row makes no service (null: it does)."""
    departs, arrives = F.col("scheduled_departure.value"), F.col("scheduled_arrival.value")
    airports = F.col("origin_airport_id").isNotNull() & F.col("destination_airport_id").isNotNull() & F.col("origin").isNotNull() & F.col("destination").isNotNull()
    reason = exclusion_reason(airports, F.col("operating_carrier").isNotNull() & F.col("operating_flight_number").isNotNull(), F.col("flight_date").isNotNull() & departs.isNotNull() & arrives.isNotNull(), (F.col("origin_airport_id") != F.col("destination_airport_id")) & (arrives > departs))
    return flights.withColumn("exclusion", reason)


def with_id(found: DataFrame, policy: str) -> DataFrame:
    id_ = service_digest(policy, F.col("flight_date"), F.col("operating_carrier"), F.col("operating_flight_number"), F.col("origin_airport_id"), F.col("destination_airport_id"), F.col("scheduled_departure.value"))
    return found.withColumn("service_id", F.when(F.col("exclusion").isNull(), id_))


def _json(fields: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "false"})


def groups(found: DataFrame) -> DataFrame:
    """(exclusion, service_id, rows, schedule_conflict, evidence_conflict) of candidates(), in one pass; service_id is null where exclusion is not.

    schedule_conflict: rows plan different things, evidence_conflict: they observe different ones, by 128-bit checksums of all fields, so that a group is hashed and not gathered.
    No row is filtered before: Spark would write the expressions of a filtered column into each other, down to the cells.
    """
    # each text is made once and hashed twice
    texts = found.select("exclusion", F.unhex("service_id").alias("_id"), _json(PLANNED).alias("_p"), _json(OBSERVED).alias("_o"))
    marked = texts.select("exclusion", "_id", *[F.xxhash64(F.lit(i), F.col(f"_{kind}")).alias(f"_{kind}{i}") for kind in ("p", "o") for i in (0, 1)])
    differ = lambda kind: (F.min(f"_{kind}0") != F.max(f"_{kind}0")) | (F.min(f"_{kind}1") != F.max(f"_{kind}1"))
    grouped = marked.groupBy("exclusion", "_id").agg(F.count("*").alias("rows"), differ("p").alias("schedule_conflict"), differ("o").alias("evidence_conflict"))
    return grouped.select("exclusion", public_id(F.col("_id")).alias("service_id"), "rows", "schedule_conflict", "evidence_conflict")


def counted(found: DataFrame) -> DataFrame:
    """(exclusion, rows) of groups(), by the parts of a service's identity: for sizes alone no digest is made of each row."""
    parts = {"_day": F.col("flight_date"), "_carrier": F.col("operating_carrier"), "_number": F.col("operating_flight_number"), "_from": F.col("origin_airport_id"), "_to": F.col("destination_airport_id"), "_departs": F.col("scheduled_departure.value")}
    keys = [F.when(F.col("exclusion").isNull(), c).alias(n) for n, c in parts.items()]
    return found.select("exclusion", *keys).groupBy("exclusion", *parts).agg(F.count("*").alias("rows")).select("exclusion", "rows")


def sized(grouped: DataFrame, max_group: int = 1000) -> DataFrame:
    """The services of groups(): those of max_group rows at most."""
    return grouped.where(F.col("exclusion").isNull() & (F.col("rows") <= max_group)).drop("exclusion")


def left_out(grouped: DataFrame, max_group: int = 1000) -> DataFrame:
    """(reason, rows) of what makes no service: rows that candidates() excluded, and groups over max_group rows."""
    reason = F.coalesce("exclusion", F.when(F.col("rows") > max_group, "oversized_group"))
    return grouped.select(reason.alias("reason"), "rows").where("reason is not null").groupBy("reason").agg(F.sum("rows").alias("rows"))


def resolve(found: DataFrame, max_group: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(services, diagnostics) of candidates().

    A service has its canonical row (the least of marketing carrier, number and record), its rows and its conflicts (groups()).
    Groups over max_group rows make no service. Diagnostics: left_out().
    """
    first = F.struct("marketing_carrier", "marketing_flight_number", "source_record_id")
    canonical = found.where("exclusion is null").groupBy("service_id").agg(F.min_by(F.struct("source_record_id", "sha256", "member", "ordinal", "flight_date", "origin_airport_id", "destination_airport_id", "operating_carrier", "operating_flight_number", F.col("scheduled_departure.value").alias("departure"), F.col("scheduled_arrival.value").alias("arrival")), first).alias("c"))
    grouped = groups(found)
    services = sized(grouped, max_group).join(canonical, "service_id").select("service_id", "rows", "schedule_conflict", "evidence_conflict", "c.*")
    return services, left_out(grouped, max_group)


def aliases(found: DataFrame) -> DataFrame:
    """(alias, service_id), each once: a service's operating, marketing and originally scheduled names, where they are whole."""
    name = {"operating": ("operating_carrier", "operating_flight_number"), "marketing": ("marketing_carrier", "marketing_flight_number"), "originally_scheduled": ("originally_scheduled_carrier", "originally_scheduled_flight_number")}
    each = F.explode(F.array(*[F.struct(F.col(c).alias("carrier"), F.col(n).alias("number")) for c, n in (name[a] for a in ALIASES)]))
    rows = found.where("exclusion is null").select("flight_date", "origin_airport_id", F.col("scheduled_departure.value").alias("departure"), "service_id", each.alias("a"))
    # pairs are made distinct by their fields; the digest is made of what is left
    whole = rows.select("flight_date", "origin_airport_id", "departure", "a.carrier", "a.number", "service_id").where("carrier is not null and number is not null").distinct()
    return whole.select(alias_digest(*[F.col(c) for c in ("flight_date", "origin_airport_id", "departure", "carrier", "number")]).alias("alias"), "service_id")


def supports(found: DataFrame, services: DataFrame) -> DataFrame:
    """(service_id, records): all records of each service, in order; a service has its own at least."""
    return services.select("service_id").join(found.where("exclusion is null").select("service_id", "source_record_id"), "service_id", "left").groupBy("service_id").agg(F.array_sort(F.collect_list("source_record_id")).alias("records"))


def tampered(services: DataFrame, flights: DataFrame, policy: str = POLICY) -> DataFrame:
    """service_id of services whose source record is missing or gives another id now."""
    now = candidates(flights, policy).select("source_record_id", F.col("service_id").alias("now"))
    return services.select("service_id", "source_record_id").join(now, "source_record_id", "left").where(~F.col("now").eqNullSafe(F.col("service_id"))).select("service_id")


def flight_option(services: DataFrame, service_id: str):
    """One service as an option to choose; KeyError if there is none."""
    found = services.where(F.col("service_id") == service_id).select("service_id", "origin_airport_id", "destination_airport_id", "departure", "arrival").limit(2).collect()
    if len(found) != 1:
        raise KeyError(service_id)
    return found[0]


def ready(services: DataFrame, conflicting: DataFrame, review: str | None, evidence: bool = True) -> bool:
    """Whether a catalog can be used: reviewed, and without a service that has a conflict or shares an alias."""
    bad = F.col("schedule_conflict") | F.col("evidence_conflict") if evidence else F.col("schedule_conflict")
    return bool(review) and services.where(bad).limit(1).isEmpty() and services.join(conflicting, "service_id", "left_semi").limit(1).isEmpty()

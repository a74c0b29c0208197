"""Raw rows to flights and diversion stops: typed cells with their issues, time facts, endpoint and quality flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as T
from ..functions.identity import digest, json_text
from ..functions.scalars import add_minutes, at_minute, blank_to_null, clock_minutes, integer_of, parse_date, parse_integer, showing
from . import airports as A
from .catalog import outcome_category

#: Columns of the flights table and the source's columns that they are read from.
INTEGERS = {
    "origin_airport_id": "OriginAirportID", "origin_airport_seq_id": "OriginAirportSeqID", "destination_airport_id": "DestAirportID", "destination_airport_seq_id": "DestAirportSeqID",
    "scheduled_elapsed_minutes": "CRSElapsedTime", "departure_delay_minutes": "DepDelay", "arrival_delay_minutes": "ArrDelay", "actual_elapsed_minutes": "ActualElapsedTime",
    "diversion_elapsed_minutes": "DivActualElapsedTime", "diversion_arrival_delay_minutes": "DivArrDelay", "diversion_landings": "DivAirportLandings", "taxi_in_minutes": "TaxiIn",
    "taxi_out_minutes": "TaxiOut", "air_time_minutes": "AirTime", "marketing_carrier_dot_id": "DOT_ID_Marketing_Airline", "operating_carrier_dot_id": "DOT_ID_Operating_Airline",
}
STRINGS = {
    "origin": "Origin", "destination": "Dest", "origin_state_name": "OriginStateName", "destination_state_name": "DestStateName", "marketing_carrier": "Marketing_Airline_Network",
    "operating_carrier": "Operating_Airline", "marketing_flight_number": "Flight_Number_Marketing_Airline", "operating_flight_number": "Flight_Number_Operating_Airline", "duplicate_flag": "Duplicate",
    "originally_scheduled_carrier": "Originally_Scheduled_Code_Share_Airline", "originally_scheduled_flight_number": "Flight_Num_Originally_Scheduled_Code_Share_Airline",
    "codeshare_partner": "Operated_or_Branded_Code_Share_Partners", "cancellation_code": "CancellationCode", "scheduled_departure_clock": "CRSDepTime", "scheduled_arrival_clock": "CRSArrTime",
    "actual_departure_clock": "DepTime", "actual_arrival_clock": "ArrTime",
}
BOOLEANS = {"cancelled": "Cancelled", "diverted": "Diverted", "diversion_reached_destination": "DivReachedDest"}
POSITIVE = {"scheduled_elapsed_minutes": "nonpositive_duration", "actual_elapsed_minutes": "nonpositive_duration", "diversion_elapsed_minutes": "nonpositive_duration", "origin_airport_id": "invalid_airport_id", "destination_airport_id": "invalid_airport_id"}
STOP_NUMBERS = ("AirportID", "AirportSeqID", "TotalGTime", "LongestGTime")
STOP_FIELDS = ("Airport", "AirportID", "AirportSeqID", "WheelsOn", "WheelsOff", "TotalGTime", "LongestGTime")
TIMES = ("scheduled_departure", "scheduled_arrival", "actual_departure", "actual_arrival")
SOURCE = ("path", "sha256", "member", "ordinal")
STOPS = 5
_STOPS = "array<struct<stop_index:int,airport_id:long,airport_seq_id:long,airport:string,landing_clock:string,departure_clock:string,total_ground_minutes:long,longest_ground_minutes:long>>"
SOURCE_COLUMNS = ["FlightDate", *INTEGERS.values(), *STRINGS.values(), *BOOLEANS.values(), *[f"Div{i}{f}" for i in range(1, STOPS + 1) for f in STOP_FIELDS]]


def widen(records: DataFrame) -> DataFrame:
    """Records (SOURCE, cells) with a column for each source column, null where an archive has none."""
    return records.select(*SOURCE, *[F.col("cells")[c].alias(c) for c in SOURCE_COLUMNS])


def record_id() -> Column:
    """The identity of a record: the digest of [sha256, member, ordinal] as canonical JSON."""
    return digest(F.concat(F.lit("["), json_text(F.col("sha256")), F.lit(","), json_text(F.col("member")), F.lit(","), F.col("ordinal").cast("string"), F.lit("]")))


def _issue(field: str, code: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.col(field).alias("raw_value")))


def parse_cells(raw: DataFrame) -> DataFrame:
    """SOURCE, the 36 typed fields, flight_date, cell_issues and what the stops are read from.

    A cell that is no integer, flag or date, and a duration or airport id that is not positive, becomes null with an issue; texts never do.
    """
    # the texts of the cells, then their numbers, are columns of their own: none is trimmed or parsed again where it is named
    counted = [*INTEGERS.values(), *BOOLEANS.values(), *[f"Div{i}{f}" for i in range(1, STOPS + 1) for f in STOP_NUMBERS]]
    read = raw.select(*SOURCE, *SOURCE_COLUMNS, parse_date(F.col("FlightDate")).alias("_day"), *[blank_to_null(F.col(c)).alias(f"_text_{c}") for c in SOURCE_COLUMNS if c != "FlightDate"])
    read = read.select("*", *[integer_of(F.col(f"_text_{c}")).alias(f"_number_{c}") for c in counted])
    text, parsed = lambda c: F.col(f"_text_{c}"), lambda c: F.col(f"_number_{c}")
    invalid = lambda c: _issue(c, "invalid_integer", text(c).isNotNull() & parsed(c).isNull())
    typed: dict[str, Column] = {n: parsed(c) for n, c in INTEGERS.items()} | {n: text(c) for n, c in STRINGS.items()}
    issues = [invalid(c) for c in INTEGERS.values()]
    flags = []
    for name, source in BOOLEANS.items():
        typed[name] = F.when(parsed(source) == 1, F.lit(True)).when(parsed(source) == 0, F.lit(False))
        issues.append(invalid(source))
        flags.append(_issue(source, "invalid_boolean", parsed(source).isNotNull() & ~parsed(source).isin(0, 1)))
    issues += flags
    typed["flight_date"] = F.col("_day")
    issues.append(_issue("FlightDate", "invalid_date", typed["flight_date"].isNull()))
    for name, code in POSITIVE.items():
        issues.append(_issue(INTEGERS[name], code, typed[name] <= 0))
        typed[name] = F.when(typed[name] > 0, typed[name])
    stops = []
    some = F.coalesce(*[text(f"Div{i}{f}") for i in range(1, STOPS + 1) for f in STOP_FIELDS]).isNotNull()
    for i in range(1, STOPS + 1):
        cell = {f: text(f"Div{i}{f}") for f in STOP_FIELDS}
        number = {f: parsed(f"Div{i}{f}") for f in STOP_NUMBERS}
        issues += [invalid(f"Div{i}{f}") for f in number]
        made = F.struct(
            F.lit(i).alias("stop_index"), number["AirportID"].alias("airport_id"), number["AirportSeqID"].alias("airport_seq_id"), cell["Airport"].alias("airport"), cell["WheelsOn"].alias("landing_clock"),
            cell["WheelsOff"].alias("departure_clock"), number["TotalGTime"].alias("total_ground_minutes"), number["LongestGTime"].alias("longest_ground_minutes"),
        )
        stops.append(F.when(F.coalesce(*cell.values()).isNotNull(), made))
    out = read.select(*SOURCE, record_id().alias("source_record_id"), *[c.alias(n) for n, c in typed.items()], F.array_compact(F.array(*issues)).alias("cell_issues"), F.when(some, F.array_compact(F.array(*stops))).otherwise(F.array().cast(_STOPS)).alias("stops"))
    return out.withColumn("outcome_category", outcome_category(F.col("cancelled"), F.col("diverted"), F.col("diversion_reached_destination")))


def with_zones(parsed: DataFrame, reference: DataFrame, overrides: DataFrame) -> DataFrame:
    """parsed with the resolutions origin_mapping and destination_mapping."""
    out = parsed
    for role in ("origin", "destination"):
        out = A.resolve(out, f"{role}_airport_id", role, "flight_date", F.col(f"{role}_state_name"), reference, overrides, f"{role}_mapping")
    return out


def _told(rows: DataFrame, name: str, cases: T.Cases) -> tuple[DataFrame, T.Parts]:
    """rows with the number of the case that holds and its instant as columns, and the fact's fields by them: rows carry no texts, and fields that nobody reads are not made."""
    number, value = F.col(f"_{name}_case"), F.col(f"_{name}_value")
    rows = rows.withColumn(f"_{name}_case", T.number_of(cases))
    rows = rows.withColumn(f"_{name}_value", T.field_of(cases, number, "value"))
    return rows, {k: value if k == "value" else T.field_of(cases, number, k) for k in T.FIELDS}


def time_facts(rows: DataFrame, tolerance: int = 0) -> DataFrame:
    """rows with the four time facts. Each step is a column of its own, so that none is computed again within the next one."""
    c, category = F.col, F.col("outcome_category")
    text = {t: c(f"{t}_clock") for t in TIMES}
    out = rows.withColumns({"_origin": c("origin_mapping.time_zone"), "_destination": c("destination_mapping.time_zone"), "_number": parse_integer(text["scheduled_departure"])})
    out = out.withColumns({"_scheduled_departure_minute": clock_minutes(c("_number"))} | {f"_{t}_minute": clock_minutes(parse_integer(text[t])) for t in TIMES[1:]})
    out = out.withColumn("_wall", at_minute(c("flight_date"), c("_scheduled_departure_minute")))
    out = out.withColumn("_guess", F.to_utc_timestamp("_wall", c("_origin")))
    out = out.withColumn("_options", showing(c("_wall"), c("_guess"), c("_origin")))
    out = out.withColumn("_fits", F.when(F.size("_options") > 1, T.fitting(c("_options"), c("scheduled_elapsed_minutes"), c("_scheduled_arrival_minute"), c("_destination"), tolerance)))
    out, departs = _told(out, "departs", T.departure_cases(c("_options"), c("_fits"), c("flight_date"), c("_number"), c("_scheduled_departure_minute"), text["scheduled_departure"], c("_origin")))
    out = out.withColumns({"_planned": add_minutes(departs["value"], c("scheduled_elapsed_minutes")), "_observed": add_minutes(departs["value"], c("departure_delay_minutes"))})
    out, planned = _told(out, "planned", T.planned_cases(departs["value"], c("_planned")))
    out, arrives = _told(out, "arrives", T.check_cases(planned, c("_scheduled_arrival_minute"), text["scheduled_arrival"], c("_destination"), tolerance))
    out, observed = _told(out, "observed", T.observed_cases(departs["value"], c("_observed"), c("departure_delay_minutes"), text["actual_departure"], category == "cancelled"))
    out, left = _told(out, "left", T.check_cases(observed, c("_actual_departure_minute"), text["actual_departure"], c("_origin"), tolerance))
    ordinary = category == "ordinary"
    by_elapsed = add_minutes(left["value"], F.when(ordinary, c("actual_elapsed_minutes")).otherwise(c("diversion_elapsed_minutes")))
    by_delay = add_minutes(arrives["value"], F.when(ordinary, c("arrival_delay_minutes")).otherwise(c("diversion_arrival_delay_minutes")))
    out = out.withColumns({"_by_elapsed": by_elapsed, "_by_delay": by_delay})
    out, combined = _told(out, "combined", T.combined_cases(c("_by_elapsed"), c("_by_delay"), tolerance))
    out, shown = _told(out, "shown", T.check_cases(combined, c("_actual_arrival_minute"), text["actual_arrival"], c("_destination"), tolerance))
    flew = category.isin("ordinary", "diverted_reached")
    out, landed = _told(out, "landed", [
        (category == "cancelled", T.parts(status="not_applicable", method="cancelled_no_arrival")), (flew & (shown["value"] <= left["value"]), T.early(shown)), (flew, shown),
        (category == "diverted_stranded", T.parts(issues=F.array(F.lit("stranded_gate_arrival_not_reported")))), (None, T.parts(issues=F.array(F.lit("outcome_unresolved")))),
    ])
    return out.select(*rows.columns, *[T.struct_of(p).alias(t) for t, p in zip(TIMES, (departs, arrives, left, landed))])


def with_places(rows: DataFrame, reference: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows whose stops are in the order of their indexes, and stop_places: zone and mapping status of each stop (null without stops)."""
    some = F.size("stops") > 0
    out = rows.withColumn("stops", F.when(some, F.array_sort("stops")).otherwise(F.col("stops")))
    for i in range(STOPS):
        out = out.withColumns({"_id": F.get("stops", F.lit(i))["airport_id"], "_code": F.get("stops", F.lit(i))["airport"]})
        out = A.resolve(out, "_id", "_code", "flight_date", None, reference, overrides, f"_mapping{i}")
    maps = F.array(*[F.struct(F.col(f"_mapping{i}.time_zone").alias("zone"), F.col(f"_mapping{i}.status").alias("status")) for i in range(STOPS)])
    return out.select(*rows.columns, F.when(some, F.slice(maps, 1, F.size("stops"))).alias("stop_places"))


def with_stops(rows: DataFrame) -> DataFrame:
    """rows of with_places() whose stops have zone, mapping status and the facts landing and departure.

    A row's stops (five at most) are mapped and timed within the row: nothing is shuffled, and rows of one record keep their own stops.
    """
    some = F.size("stops") > 0
    out = rows.withColumns({"_maps": F.col("stop_places"), "_lower": F.col("actual_departure.value"), "_upper": F.col("actual_arrival.value")})

    def held(s: Column, i: Column) -> Column:
        zone = F.get("_maps", i)["zone"]
        ends = [T.stop_domain(s[clock], zone, F.col("_lower"), F.col("_upper")).alias(end) for end, clock in (("landing", "landing_clock"), ("departure", "departure_clock"))]
        return F.struct(s.alias("stop"), zone.alias("time_zone"), F.get("_maps", i)["status"].alias("mapping_status"), *ends)

    out = out.withColumn("_held", F.when(some, F.transform("stops", held)))
    out = out.withColumn("_domains", F.flatten(F.transform("_held", lambda x: F.array(x["landing"]["values"], x["departure"]["values"]))))
    out = out.withColumn("_swept", F.when(some, T.swept(F.col("_domains"), F.col("_lower"), F.col("_upper"))))
    out = out.withColumn("_conflict", F.when(some, F.exists(F.arrays_zip("_domains", "_swept"), lambda z: (F.size(z["_domains"]) > 0) & (F.size(z["_swept"]) == 0))))
    facts = F.transform("_held", lambda x, i: F.struct(
        *[x["stop"][c].alias(c) for c in ("stop_index", "airport_id", "airport_seq_id", "airport", "landing_clock", "departure_clock", "total_ground_minutes", "longest_ground_minutes")], x["time_zone"].alias("time_zone"), x["mapping_status"].alias("mapping_status"),
        T.stop_fact(x["landing"]["issue"], F.get("_swept", i * 2), F.col("_conflict")).alias("landing"), T.stop_fact(x["departure"]["issue"], F.get("_swept", i * 2 + 1), F.col("_conflict")).alias("departure"),
    ))
    kept = [c for c in rows.columns if c not in ("stops", "stop_places")]
    made = out.select(*kept, F.when(some, facts).alias("stops"))
    return made.withColumn("stops", F.coalesce("stops", F.array().cast(made.schema["stops"].dataType)))


def _complete() -> Column:
    """Whether the stops are all that were counted, in order, each with its airport."""
    stops, count = F.col("stops"), F.col("diversion_landings")
    in_order = F.transform(stops, lambda s: s["stop_index"]) == F.when(count.between(1, STOPS), F.sequence(F.lit(1), count.cast("int")))
    return F.coalesce((F.size(stops) > 0) & in_order & F.forall(stops, lambda s: s["airport_id"].isNotNull() & s["airport"].isNotNull()), F.lit(False))


def with_endpoint(rows: DataFrame) -> DataFrame:
    """rows with the endpoint, its status and issues; of cells alone, so that neither airports nor times are looked up for it."""
    stops, category = F.col("stops"), F.col("outcome_category")
    rows = rows.withColumn("_complete", (category == "diverted_stranded") & _complete())
    at_destination, cancelled, stranded = category.isin("ordinary", "diverted_reached"), category == "cancelled", F.col("_complete")
    last = F.element_at(stops, F.when(F.size(stops) > 0, -1))
    pick = lambda role, field: F.when(at_destination, F.col(f"destination{role}")).when(cancelled, F.col(f"origin{role}")).when(stranded, last[field])
    method = F.when(at_destination, "reported_scheduled_destination").when(cancelled, "cancelled_at_origin").when(stranded, "reported_final_diversion_stop").otherwise("unresolved")
    out = rows.withColumns({"endpoint_airport_id": pick("_airport_id", "airport_id"), "endpoint": pick("", "airport"), "_method": method})
    known = F.col("endpoint_airport_id").isNotNull() & F.col("endpoint").isNotNull()
    issues = F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("endpoint_not_supported")))
    return out.withColumns({"endpoint_status": F.when(known, F.col("_method")).otherwise("unresolved"), "endpoint_issues": issues}).drop("_method", "_complete")


def with_flags(rows: DataFrame) -> DataFrame:
    """rows of with_places() with the sorted quality flags."""
    stops, diverted = F.col("stops"), F.coalesce(F.col("diverted"), F.lit(False))
    rows = rows.withColumn("_complete", _complete())
    mapping = lambda role: F.when(F.col(f"{role}_mapping.status") != "resolved", F.concat(F.lit(f"{role}_mapping_"), F.col(f"{role}_mapping.status")))
    flags = F.array(
        mapping("origin"), mapping("destination"), F.when(F.exists("stop_places", lambda s: s["status"] != "resolved"), "diversion_mapping_unresolved"),
        F.when((F.size(stops) > 0) & ~diverted, "diversion_stops_without_diversion_flag"), F.when(diverted & ~F.col("_complete"), "incomplete_diversion_stop_sequence"),
    )
    return rows.withColumn("quality_flags", F.array_sort(F.array_distinct(F.array_compact(flags)))).drop("_complete")


def normalize(raw: DataFrame, reference: DataFrame, overrides: DataFrame, tolerance: int = 0) -> DataFrame:
    """Flights of raw rows (SOURCE and SOURCE_COLUMNS), each with its stops as an array; nothing is dropped."""
    parsed = parse_cells(raw)
    placed = with_places(with_zones(parsed, reference, overrides), reference, overrides)
    made = with_stops(time_facts(with_flags(with_endpoint(placed)), tolerance))
    ends = ["endpoint_airport_id", "endpoint", "quality_flags", "endpoint_status", "endpoint_issues"]
    return made.select(*[c for c in made.columns if c not in (*ends, "stops")], "stops", *ends)


def has_stops() -> Column:
    """Whether a raw row has a cell of a stop: the others have no stops, whatever else they hold."""
    return F.coalesce(*[blank_to_null(F.col(f"Div{i}{f}")) for i in range(1, STOPS + 1) for f in STOP_FIELDS]).isNotNull()


def endpoint_counts(parsed: DataFrame) -> DataFrame:
    """(category, status, n, airports): flights and the sum of their endpoints' ids; what an endpoint hangs on is counted first, so it is found once for each combination."""
    cells = ["outcome_category", "origin_airport_id", "origin", "destination_airport_id", "destination", "diversion_landings", "stops"]
    same = parsed.select(*cells[:-1], F.array_sort("stops").alias("stops")).groupBy(*cells).agg(F.count("*").alias("n"))
    ended = with_endpoint(same).select(F.col("outcome_category").alias("category"), F.col("endpoint_status").alias("status"), "n", (F.col("endpoint_airport_id") * F.col("n")).alias("airports"))
    return ended.groupBy("category", "status").agg(F.sum("n").alias("n"), F.sum("airports").alias("airports"))


def flag_counts(zoned: DataFrame, reference: DataFrame, overrides: DataFrame) -> DataFrame:
    """(flag, n) of rows of with_zones(); rows with the same mappings and stops are counted first (the day counts only where a stop is to be mapped)."""
    status = lambda role: F.col(f"{role}_mapping.status").alias(role)
    same = zoned.select(status("origin"), status("destination"), "diverted", "diversion_landings", "stops", F.when(F.size("stops") > 0, F.col("flight_date")).alias("flight_date"))
    same = same.groupBy(*same.columns).agg(F.count("*").alias("n")).withColumns({f"{r}_mapping": F.struct(F.col(r).alias("status")) for r in ("origin", "destination")})
    flags = with_flags(with_places(same, reference, overrides)).select("n", F.explode_outer("quality_flags").alias("flag"))
    return flags.where("flag is not null").groupBy("flag").agg(F.sum("n").alias("n"))


def stop_rows(flights: DataFrame) -> DataFrame:
    """The table of diversion stops: a row for each stop of each flight. (Of a plain explode Spark makes a filter that repeats the expressions of the stops.)"""
    return flights.select("source_record_id", F.col("ordinal").alias("source_row_id"), F.explode_outer("stops").alias("s")).where("s is not null").select("source_record_id", "source_row_id", "s.*")


def issue_counts(flights: DataFrame) -> DataFrame:
    """Invalid cells by field and code."""
    return flights.select(F.explode_outer("cell_issues").alias("i")).where("i is not null").groupBy("i.field", "i.code").agg(F.count("*").alias("n"))


def null_counts(flights: DataFrame) -> DataFrame:
    """(field, nulls) of the 36 typed fields, counted in one pass."""
    names = [*INTEGERS, *STRINGS, *BOOLEANS]
    counted = flights.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in names])).alias("x")).select("x.*")


def fact_counts(flights: DataFrame, facts: Mapping[str, Column] | None = None, kinds: Sequence[str] = ("status", "method", "issue", "check")) -> DataFrame:
    """(category, field, kind, value, n): statuses, methods, issues and checks of the time facts by outcome category.

    Flights that tell the same are counted first, so what is taken apart is a row for each combination and not for each flight.
    """
    facts = {t: F.col(t) for t in TIMES} if facts is None else facts
    read = {"status": lambda f: F.array(f["status"]), "method": lambda f: F.array(F.coalesce(f["method"], F.lit("none"))), "issue": lambda f: f["issues"], "check": lambda f: f["checks"]}
    names = [(field, kind, f"_{i}_{kind}") for i, field in enumerate(facts) for kind in kinds]
    rows = flights.select(F.col("outcome_category").alias("category"), *[read[kind](facts[field]).alias(n) for field, kind, n in names])
    same = rows.groupBy("category", *[n for *_, n in names]).agg(F.count("*").alias("n"))
    tell = lambda field, kind, n: F.transform(n, lambda x: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), x.alias("value")))
    told = F.concat(*[tell(*x) for x in names])
    return same.select("category", "n", F.explode(told).alias("t")).groupBy("category", "t.field", "t.kind", "t.value").agg(F.sum("n").alias("n"))


def stop_fact_counts(flights: DataFrame) -> DataFrame:
    """(field, kind, value, n): statuses and issues of the stops' landings and departures."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("f")) for f in ("landing", "departure")]))
    rows = stop_rows(flights).select(each.alias("e")).select("e.field", "e.f.*")
    told = F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value"))), F.transform("issues", lambda x: F.struct(F.lit("issue").alias("kind"), x.alias("value"))))
    return rows.select("field", F.explode(told).alias("t")).groupBy("field", "t.kind", "t.value").agg(F.count("*").alias("n"))


def stop_faults(flights: DataFrame, stops: DataFrame) -> DataFrame:
    """(source_record_id, fault): stops without a flight, and flights whose stop_count is not the number of their stops."""
    counted = stops.groupBy("source_record_id").agg(F.count("*").alias("n"))
    both = flights.select("source_record_id", "stop_count").join(counted, "source_record_id", "full")
    fault = F.when(F.col("stop_count").isNull(), "orphan_stops").when(F.coalesce("n", F.lit(0)) != F.col("stop_count"), "stop_count_mismatch")
    return both.select("source_record_id", fault.alias("fault")).where("fault is not null")

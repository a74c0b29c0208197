"""Time facts: an instant with its status, method, issues, checks and evidence, and how they are reconstructed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import add_minutes, clock_agrees, clock_minutes, local_candidates, parse_integer

FACT = "struct<value:timestamp,status:string,method:string,issues:array<string>,checks:array<string>,evidence:array<timestamp>>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


#: The fields of a fact by name, as columns of their own; and what a fact can be, each with its condition (None: otherwise).
Parts = dict[str, Column]
Cases = Sequence[tuple[Column | None, Parts]]
FIELDS = ("value", "status", "method", "issues", "checks", "evidence")


def _texts(*values: Column | str) -> Column:
    if all(isinstance(v, str) for v in values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return F.array_compact(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]))


def parts(value: Column | None = None, status: str = "unresolved", method: str | None = None, issues: Column | None = None, checks: Column | None = None, evidence: Column | None = None) -> Parts:
    none = F.array().cast("array<string>")
    return {
        "value": F.lit(None).cast("timestamp") if value is None else value, "status": F.lit(status), "method": F.lit(method).cast("string"),
        "issues": none if issues is None else issues, "checks": none if checks is None else checks, "evidence": F.array().cast("array<timestamp>") if evidence is None else evidence,
    }


def parts_of(f: Column) -> Parts:
    return {k: f[k] for k in FIELDS}


def struct_of(p: Parts) -> Column:
    """A fact out of its fields; not cast, so that where one field is read, the others are not made."""
    return F.struct(*[p[k].alias(k) for k in FIELDS])


def number_of(cases: Cases) -> Column:
    """The place of the first case that holds."""
    return first_of([(c, F.lit(i)) for i, (c, _) in enumerate(cases)])


def first_of(values: Sequence[tuple[Column | None, Column]]) -> Column:
    out = F
    for condition, value in values[:-1]:
        out = out.when(condition, value)
    return out.otherwise(values[-1][1]) if len(values) > 1 else values[0][1]


def field_of(cases: Cases, number: Column, field: str) -> Column:
    """One field of the case with this number; cases that share it are named at once, so that fields of facts made of facts stay short."""
    held: dict[int, tuple[Column, list[int]]] = {}
    for i, (_, p) in enumerate(cases):
        held.setdefault(id(p[field]), (p[field], []))[1].append(i)
    *some, (last, _) = sorted(held.values(), key=lambda x: len(x[1]))
    return first_of([*[(number.isin(places), value) for value, places in some], (None, last)])


def whole(cases: Cases) -> Column:
    return first_of([(c, struct_of(p).cast(FACT)) for c, p in cases])


def fact(value: Column, status: Column, method: Column | None = None, issues: Column | None = None, checks: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        value.cast("timestamp").alias("value"), status.alias("status"), (method if method is not None else F.lit(None)).cast("string").alias("method"),
        (issues if issues is not None else none).alias("issues"), (checks if checks is not None else none).alias("checks"),
        (evidence if evidence is not None else F.array()).cast("array<timestamp>").alias("evidence"),
    ).cast(FACT)


def resolved(value: Column, method: str, checks: Column | None = None) -> Column:
    return fact(value, F.lit("resolved"), F.lit(method), None, checks, F.array(value))


def unknown(issue: Column | str, method: str | None = None, evidence: Column | None = None) -> Column:
    return fact(F.lit(None), F.lit("unresolved"), F.lit(method), _texts(issue), None, evidence)


def check_clock(f: Column, raw_clock: Column, zone: Column, tolerance: int = 0) -> Column:
    """The fact, checked against a reported clock.

    A missing clock or zone adds a check, an invalid clock also an issue; the value stays. A clock that disagrees
    takes the value away and makes the fact a contradiction.
    """
    return let(f, lambda g: let(clock_minutes(parse_integer(raw_clock)), lambda m: checked(g, m, raw_clock, zone, tolerance)))


def checked(f: Column, minute: Column, raw_clock: Column, zone: Column, tolerance: int) -> Column:
    return whole(check_cases(parts_of(f), minute, raw_clock, zone, tolerance))


def check_cases(f: Parts, minute: Column, raw_clock: Column, zone: Column, tolerance: int) -> Cases:
    said = lambda check, **more: {**f, "checks": F.concat(f["checks"], _texts(check)), **more}
    more = lambda issue: F.concat(f["issues"], _texts(issue))
    return [
        (f["value"].isNull(), f),
        (F.coalesce(F.trim(raw_clock), F.lit("")) == "", said("reported_clock_missing")),
        (minute.isNull(), said("reported_clock_invalid", issues=more("invalid_reported_clock"))),
        (zone.isNull(), said("reported_clock_timezone_missing")),
        (clock_agrees(f["value"], minute, zone, tolerance), said("reported_clock_agrees")),
        (None, said("reported_clock_disagrees", value=F.lit(None).cast("timestamp"), status=F.lit("contradiction"), issues=more("reported_clock_disagrees"))),
    ]


def scheduled_departure(day: Column, clock: Column, elapsed: Column, arrival_clock: Column, origin_zone: Column, destination_zone: Column) -> Column:
    """The scheduled instant of departure; of two candidates of a fold, the one whose arrival shows the scheduled arrival clock."""
    number = parse_integer(clock)
    minute, shown = clock_minutes(number), clock_minutes(parse_integer(arrival_clock))
    return let(local_candidates(day, minute, origin_zone), lambda options: departure_of(options, day, number, minute, clock, elapsed, shown, origin_zone, destination_zone))


def departure_of(options, day, number, minute, clock, elapsed, shown, origin_zone, destination_zone, tolerance: int = 0) -> Column:
    """The scheduled departure out of its candidate instants; number and minute: the departure clock read, shown: the minute of the arrival clock."""
    return whole(departure_cases(options, fitting(options, elapsed, shown, destination_zone, tolerance), day, number, minute, clock, origin_zone))


def fitting(options: Column, elapsed: Column, shown: Column, destination_zone: Column, tolerance: int = 0) -> Column:
    """The candidates after which the arrival clock shows what it should."""
    return F.filter(options, lambda c: F.coalesce(clock_agrees(add_minutes(c, elapsed), shown, destination_zone, tolerance), F.lit(False)))


def departure_cases(options: Column, fits: Column, day: Column, number: Column, minute: Column, clock: Column, origin_zone: Column) -> Cases:
    told = lambda issue: parts(issues=_texts(issue))
    of = lambda value, method: parts(value, "resolved", method, evidence=F.array(value))
    return [
        (day.isNull(), told("missing_flight_date")),
        (origin_zone.isNull(), told("origin_timezone_unresolved")),
        (F.coalesce(clock, F.lit("")) == "", told("missing_departure_clock")),
        (minute.isNull(), told("invalid_departure_clock")),
        (number == 2400, told("midnight_date_ambiguous")),
        (F.size(options) == 0, told("nonexistent_local_time")),
        (F.size(options) == 1, of(options[0], "scheduled_local")),
        (F.size(fits) == 1, of(fits[0], "scheduled_fold_disambiguated")),
        (None, parts(issues=_texts("ambiguous_local_time"), evidence=options)),
    ]


def scheduled_arrival(departure: Column, elapsed: Column, clock: Column, zone: Column, tolerance: int = 0) -> Column:
    return let(departure, lambda d: _arrival(d, elapsed, clock, zone, tolerance))


def _arrival(departure: Column, elapsed: Column, clock: Column, zone: Column, tolerance: int) -> Column:
    return check_clock(planned_arrival(departure, elapsed), clock, zone, tolerance)


def planned_arrival(departure: Column, elapsed: Column) -> Column:
    """The scheduled arrival before its check against the clock."""
    return whole(planned_cases(departure["value"], add_minutes(departure["value"], elapsed)))


def planned_cases(departure: Column, value: Column) -> Cases:
    told = lambda issue: parts(method="scheduled_elapsed", issues=_texts(issue))
    return [(departure.isNull(), told("schedule_departure_unresolved")), (value.isNull(), told("missing_or_invalid_scheduled_elapsed")), (None, parts(value, "resolved", "scheduled_elapsed", evidence=F.array(value)))]


def actual_departure(scheduled: Column, delay: Column, clock: Column, zone: Column, cancelled: Column, tolerance: int = 0) -> Column:
    return let(scheduled, lambda s: _left(s, delay, clock, zone, cancelled, tolerance))


def _left(scheduled: Column, delay: Column, clock: Column, zone: Column, cancelled: Column, tolerance: int) -> Column:
    return check_clock(observed_departure(scheduled, delay, clock, cancelled), clock, zone, tolerance)


def observed_departure(scheduled: Column, delay: Column, clock: Column, cancelled: Column) -> Column:
    """The actual departure before its check against the clock; a cancelled flight without delay and clock has none."""
    return whole(observed_cases(scheduled["value"], add_minutes(scheduled["value"], delay), delay, clock, cancelled))


def observed_cases(scheduled: Column, value: Column, delay: Column, clock: Column, cancelled: Column) -> Cases:
    told = lambda issue: parts(method="departure_delay", issues=_texts(issue))
    absent = F.coalesce(cancelled, F.lit(False)) & delay.isNull() & (F.coalesce(F.trim(clock), F.lit("")) == "")
    return [
        (value.isNotNull(), parts(value, "resolved", "departure_delay", evidence=F.array(value))),
        (absent, parts(status="not_applicable", method="cancelled_no_departure_reported")),
        (scheduled.isNull(), told("schedule_departure_unresolved")),
        (None, told("departure_delay_missing")),
    ]


def combine_arrivals(by_elapsed: Column, by_delay: Column, tolerance: int = 0) -> Column:
    """One arrival from two paths: that by elapsed time where both agree; a contradiction with both as evidence where they do not."""
    return whole(combined_cases(by_elapsed, by_delay, tolerance))


def combined_cases(by_elapsed: Column, by_delay: Column, tolerance: int = 0) -> Cases:
    gap = F.abs(F.unix_micros(by_elapsed) - F.unix_micros(by_delay)) / 60_000_000
    of = lambda value, method, check, *seen: parts(value, "resolved", method, checks=_texts(check), evidence=F.array(*(seen or (value,))))
    return [
        (by_elapsed.isNull() & by_delay.isNull(), parts(issues=_texts("no_supported_arrival_path"))),
        (by_delay.isNull(), of(by_elapsed, "elapsed_only", "arrival_delay_path_missing")),
        (by_elapsed.isNull(), of(by_delay, "arrival_delay_only", "elapsed_path_missing")),
        (gap <= tolerance, of(by_elapsed, "both_agree", "arrival_paths_agree", by_elapsed, by_delay)),
        (None, parts(None, "contradiction", "two_paths", _texts("arrival_paths_disagree"), _texts("arrival_paths_disagree"), F.array(by_elapsed, by_delay))),
    ]


def actual_arrival(by_elapsed: Column, by_delay: Column, departure: Column, clock: Column, zone: Column, tolerance: int = 0) -> Column:
    return let(check_clock(combine_arrivals(by_elapsed, by_delay, tolerance), clock, zone, tolerance), lambda f: after(f, departure))


def after(f: Column, departure: Column) -> Column:
    """The arrival, a contradiction if it is not after the departure."""
    p = parts_of(f)
    return whole([(p["value"] <= departure, early(p)), (None, p)])


def early(f: Parts) -> Parts:
    return {**f, "value": F.lit(None).cast("timestamp"), "status": F.lit("contradiction"), "issues": F.concat(f["issues"], _texts("arrival_not_after_departure"))}


def window_candidates(clock: Column, zone: Column, lower: Column, upper: Column) -> Column:
    """Instants inside [lower, upper] at which a zone's clocks show the clock, over the local days between; rising. Null windows have none."""
    minute = clock_minutes(parse_integer(clock))
    first, last = (F.to_date(F.from_utc_timestamp(x, zone)) for x in (lower, upper))
    days = F.when((lower <= upper) & (F.datediff(last, first) <= 366), F.sequence(first, last))
    found = F.flatten(F.transform(days, lambda d: local_candidates(d, minute, zone)))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda c: (c >= lower) & (c <= upper)))), F.array().cast("array<timestamp>"))


def propagate(domains: Column) -> Column:
    """Domains (arrays of rising candidate instants; an empty one is unknown) after chronology: each later than what can precede, earlier than what can follow.

    One fold forward over the least instants, one backward over the greatest. If a known domain empties, all known ones become empty (a contradiction).
    """
    empty = F.array().cast("array<timestamp>")
    start = F.struct(F.lit(None).cast("timestamp").alias("edge"), F.array().cast("array<array<timestamp>>").alias("out"))

    def sweep(xs: Column, ahead: bool) -> Column:
        def step(acc: Column, d: Column) -> Column:
            ok = F.filter(d, lambda c: acc["edge"].isNull() | ((c >= acc["edge"]) if ahead else (c <= acc["edge"])))
            edge = F.coalesce(F.array_min(ok) if ahead else F.array_max(ok), acc["edge"])
            return F.struct(edge.alias("edge"), F.concat(acc["out"], F.array(ok)).alias("out"))

        return F.aggregate(xs, start, step)["out"]

    swept = F.reverse(sweep(F.reverse(sweep(domains, True)), False))
    emptied = F.exists(F.arrays_zip(domains.alias("a"), swept.alias("b")), lambda z: (F.size(z["a"]) > 0) & (F.size(z["b"]) == 0))
    return F.when(emptied, F.transform(domains, lambda d: empty)).otherwise(swept)


def stop_domain(clock: Column, zone: Column, lower: Column, upper: Column) -> Column:
    """struct(issue, values): the instants at which a stop's clock can have been read between departure and arrival, or why there are none."""
    minute = clock_minutes(parse_integer(clock))
    values = window_candidates(clock, zone, lower, upper)
    days = F.datediff(F.to_date(F.from_utc_timestamp(upper, zone)), F.to_date(F.from_utc_timestamp(lower, zone)))
    issue = (
        F.when(F.coalesce(F.trim(clock), F.lit("")) == "", "stop_clock_missing").when(minute.isNull(), "invalid_stop_clock").when(zone.isNull(), "stop_timezone_unresolved")
        .when(lower.isNull() | upper.isNull(), "missing_time_anchor").when(upper < lower, "inconsistent_time_anchors").when(days > 366, "reconstruction_window_exceeds_resource_limit")
        .when(F.size(values) == 0, "stop_clock_outside_anchors")
    )
    return F.struct(issue.alias("issue"), F.when(issue.isNull(), values).otherwise(F.array().cast("array<timestamp>")).alias("values"))


def swept(domains: Column, lower: Column, upper: Column) -> Column:
    """Domains after both sweeps from the anchors, each known one on its own: an empty one here that was not is a contradiction."""
    start = lambda edge: F.struct(edge.alias("edge"), F.array().cast("array<array<timestamp>>").alias("out"))

    def sweep(xs: Column, edge: Column, ahead: bool) -> Column:
        def step(acc: Column, d: Column) -> Column:
            ok = F.filter(d, lambda c: acc["edge"].isNull() | ((c >= acc["edge"]) if ahead else (c <= acc["edge"])))
            return F.struct(F.coalesce(F.array_min(ok) if ahead else F.array_max(ok), acc["edge"]).alias("edge"), F.concat(acc["out"], F.array(ok)).alias("out"))

        return F.aggregate(xs, start(edge), step)["out"]

    return F.reverse(sweep(F.reverse(sweep(domains, lower, True)), upper, False))


def stop_fact(issue: Column, values: Column, conflict: Column) -> Column:
    """The fact of one clock of a stop out of its instants after the sweeps; conflict: a clock of the flight was left without any."""
    method = "bounded_stop_clock"
    return (
        F.when(conflict & (F.size(values) > 0), fact(F.lit(None), F.lit("contradiction"), F.lit(method), _texts("stop_chronology_conflict"), None, values))
        .when(issue.isNotNull(), unknown(issue, method))
        .when(F.size(values) == 1, resolved(values[0], "unique_bounded_stop_clock"))
        .when(F.size(values) == 0, unknown("stop_chronology_conflict", method, values))
        .otherwise(unknown("ambiguous_stop_date", method, values))
    )

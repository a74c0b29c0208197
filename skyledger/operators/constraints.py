"""Record constraints as one column of violated rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT = "array<string>"
#: Fixed values.
REASONS = ("destination_reached", "time_limit", "decision_limit", "no_feasible_flights", "unresolved_diversion_timing", "unresolved_outcome")
STATUSES = ("ARRIVED", "CANCELLED", "DIVERTED", "MISSED_BOARDING", "UNRESOLVED")


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])).cast(TEXT)


def hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def airport(id_: Column, code: Column) -> dict[str, Column]:
    return {"airport_id": id_ > 0, "airport_code": code.rlike("^[A-Z0-9]{3,4}$")}


def trip_request(origin: Column, destination: Column, start: Column, deadline: Column) -> dict[str, Column]:
    return {"same_airport": origin != destination, "deadline_not_after_start": deadline > start}


def flight_option(origin: Column, destination: Column, departure: Column, arrival: Column) -> dict[str, Column]:
    return {"same_airport": origin != destination, "arrival_not_after_departure": arrival > departure}


def diversion_stop(landed: Column, departed: Column) -> dict[str, Column]:
    return {"departed_before_landing": landed.isNull() | departed.isNull() | (departed >= landed)}


def episode_settings(limit: Column, decisions: Column, *buffers: Column) -> dict[str, Column]:
    return {"limits": (limit > 0) & (decisions > 0)} | {f"buffer_{i}": b >= 0 for i, b in enumerate(buffers)}


def texts(**values: Column) -> dict[str, Column]:
    """Texts are not blank."""
    return {f"{k}_blank": F.trim(v) != "" for k, v in values.items()}


def source_ref(sha256: Column, row: Column) -> dict[str, Column]:
    return {"source_sha256": hex64(sha256), "source_row": row > 0}


def schedule_ref(snapshot: Column, service: Column) -> dict[str, Column]:
    return {"schedule_snapshot": hex64(snapshot), "schedule_service": hex64(service)}


def historical_sample(pool: Column, size: Column, ordinal: Column) -> dict[str, Column]:
    return {"sample_pool": hex64(pool), "sample_size": size > 0, "sample_ordinal": (ordinal >= 0) & (ordinal < size)}


def provenance(seed: Column, keys: Column) -> dict[str, Column]:
    """keys: names of the parameters."""
    return {"seed": seed >= 0, "parameters_repeat": F.size(keys) == F.size(F.array_distinct(keys))}


def scenario(name: Column, seed: Column, version: Column, versions: Sequence[str]) -> dict[str, Column]:
    return texts(scenario=name) | {"seed": seed >= 0, "sampler_version": version.isin(*versions)}


def resolution_policy(version: Column, versions: Sequence[str], max_group: Column) -> dict[str, Column]:
    return {"policy_version": version.isin(*versions), "max_group": max_group > 0}


def rubric(points: Column, total: Column) -> dict[str, Column]:
    """points: of the components, each a share of 100."""
    return {"points_range": F.forall(points, lambda p: (p >= 0) & (p <= 100)), "points_sum": F.aggregate(points, F.lit(0).cast("double"), lambda a, p: a + p) == total}


def verification(passed: Column, mismatches: Column) -> dict[str, Column]:
    return {"passed_with_mismatches": passed == (mismatches == 0)}


def flown(status: Column, reason: Column, arrival: Column, next_decision: Column, airport: Column, stops: Column) -> dict[str, Column]:
    """What an outcome's status asks for: who arrives has an arrival and goes on from there, who is cancelled or left behind goes on, what is unresolved does not."""
    goes_on = next_decision.isNotNull() & airport.isNotNull()
    return {
        "status": status.isin(*STATUSES), "arrived": (status != "ARRIVED") | (goes_on & reason.isNull()), "stays": ~status.isin("CANCELLED", "MISSED_BOARDING") | (goes_on & reason.isNull()),
        "unresolved": (status != "UNRESOLVED") | (reason.isNotNull() & airport.isNull() & next_decision.isNull()), "diverted": (status != "DIVERTED") | (reason.isNull() == next_decision.isNotNull()),
        "stops_elsewhere": (F.size(stops) == 0) | (status == "DIVERTED"), "arrival_is_next": arrival.isNull() | next_decision.isNull() | (arrival == next_decision),
    }


def decision_step(origin: Column, airport: Column, ready: Column, departure: Column, decision: Column, offered: Column, service: Column) -> dict[str, Column]:
    """The chosen flight was offered, leaves from where the traveller is, and not before they can board."""
    return {"not_offered": F.array_contains(offered, service), "elsewhere": origin == airport, "not_ready": departure >= ready, "ready_before_decision": ready >= decision}


def episode(steps: Column, origin: Column, start: Column, reason: Column, limit: int) -> dict[str, Column]:
    """A whole trip: steps (step, from, decision, ready, service_id, status, reason, next_decision, airport) follow from each other, and the end from the last one."""
    pairs = F.transform(F.filter(steps, lambda x: x["step"] > 0), lambda x: F.struct(x.alias("b"), F.filter(steps, lambda y: y["step"] == x["step"] - 1)[0].alias("a")))
    last = F.element_at(steps, F.when(F.size(steps) > 0, -1))
    some = F.size(steps) > 0
    return {
        "numbering": F.transform(steps, lambda x: x["step"]) == F.when(some, F.sequence(F.lit(0), F.size(steps) - 1)).otherwise(F.array().cast("array<int>")),
        "first_place": ~some | (steps[0]["from"] == origin), "first_time": ~some | (steps[0]["decision"] == start),
        "places": F.forall(pairs, lambda p: p["b"]["from"] == p["a"]["airport"]), "times": F.forall(pairs, lambda p: p["b"]["decision"] == p["a"]["next_decision"]),
        "buffers": F.forall(pairs, lambda p: p["b"]["ready"] - p["b"]["decision"] == F.when(p["a"]["status"].isin("CANCELLED", "MISSED_BOARDING"), 0).otherwise(45)),
        "repeats": F.size(F.array_distinct(F.transform(steps, lambda x: x["service_id"]))) == F.size(steps), "limit": F.size(steps) <= limit, "reason": reason.isin(*REASONS),
        "unresolved_end": ~reason.isin(*REASONS) | F.coalesce(last["next_decision"].isNotNull(), F.lit(True)) | reason.isin("time_limit", "unresolved_diversion_timing", "unresolved_outcome"),
    }


def outcome(status: Column, times: Column, stops: Column) -> dict[str, Column]:
    """times: known instants in the order they must have; stops: their number."""
    known = F.array_compact(times)
    return {"status": status.isin(*STATUSES), "chronology": known == F.array_sort(known), "stops": stops <= 5}

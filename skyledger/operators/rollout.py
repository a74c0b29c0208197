"""Transitions of sampled outcomes, batch rollout of trips, score and verification by recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECOVERY, FIRST_BUFFER, NEXT_BUFFER, MISSED_BUFFER = 60, 60, 45, 0


STOP = "array<struct<stop_index:int,airport_id:bigint,code:string,landed:bigint,departed:bigint>>"


def shifted(time: Column, anchor: Column, selected: Column) -> Column:
    """An observed instant of the evidence, moved with the whole timeline from its own scheduled departure to the selected one."""
    return time + (selected - anchor)


def shifted_stops(stops: Column, anchor: Column, selected: Column) -> Column:
    move = lambda t: shifted(t, anchor, selected)
    return F.transform(stops, lambda x: F.struct(x["stop_index"].alias("stop_index"), x["airport_id"].alias("airport_id"), x["code"].alias("code"), move(x["landed"]).alias("landed"), move(x["departed"]).alias("departed")))


def transition(
    category: Column, departure: Column, arrival: Column, scheduled: Column, ready: Column, decision: Column, cutoff: Column,
    stops: Column | None = None, landings: Column | None = None, origin: Column | None = None, destination: Column | None = None, anchored: Column | None = None,
) -> Column:
    """struct(status, reason, next_decision, airport, stops) of a flight; instants are minutes, null if unknown.

    The cascade in its order: no anchor to move the evidence by, cancellation (recovery an hour after the selected departure), unclassified, missed
    boarding, contradictory times, cutoff, arrival, diversion. A diversion is complete if its stops are valid, numbered from 1 and as many as the
    landings reported; only then it ends at the destination (reached, both times known) or at the last stop (stranded). stops: STOP, those observed.
    """
    place = lambda c: F.lit(None).cast("long") if c is None else c
    stops = F.array().cast(STOP) if stops is None else F.coalesce(stops.cast(STOP), F.array().cast(STOP))
    landings = F.lit(None).cast("int") if landings is None else landings
    none = F.array().cast(STOP)
    made = lambda status, reason=None, after=None, at=None, seen=none: F.struct(
        F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason") if not isinstance(reason, Column) else reason.alias("reason"),
        (F.lit(None) if after is None else after).cast("long").alias("next_decision"), place(at).cast("long").alias("airport"), seen.alias("stops"),
    )
    recovery = scheduled + RECOVERY
    valid = F.filter(stops, lambda x: F.coalesce((x["airport_id"] > 0) & x["code"].rlike("^[A-Z0-9]{3,4}$"), F.lit(False)))
    times = F.concat(F.array(departure.cast("long")), F.flatten(F.transform(valid, lambda x: F.array(x["landed"], x["departed"]))), F.array(arrival.cast("long")))
    known = F.array_compact(times)
    wrong = (known != F.array_sort(known)) | F.exists(known, lambda t: t < decision) | F.coalesce(arrival <= departure, F.lit(False))
    late = F.exists(known, lambda t: t > cutoff)
    in_time = lambda t: F.when(t <= cutoff, t)
    before = F.filter(valid, lambda x: in_time(x["landed"]).isNotNull() | in_time(x["departed"]).isNotNull())
    before = F.transform(before, lambda x: F.struct(x["stop_index"].alias("stop_index"), x["airport_id"].alias("airport_id"), x["code"].alias("code"), in_time(x["landed"]).alias("landed"), in_time(x["departed"]).alias("departed")))
    size = F.size(valid)
    numbered = F.transform(stops, lambda x: x["stop_index"]) == F.when(size > 0, F.sequence(F.lit(1), size))
    complete = F.coalesce((size == F.size(stops)) & (size > 0) & (landings == size) & numbered, F.lit(False))
    diverted = category.startswith("diverted")
    reached = (category == "diverted_reached") & complete & departure.isNotNull() & arrival.isNotNull()
    last = F.when((category == "diverted_stranded") & complete, F.element_at(valid, F.when(size > 0, -1))["airport_id"])
    anchored = F.lit(True) if anchored is None else anchored
    return (
        F.when(~anchored, made("UNRESOLVED", "missing_transfer_anchor"))
        .when(category == "cancelled", F.when(departure.isNotNull(), made("UNRESOLVED", "cancelled_with_departure_evidence")).when(recovery > cutoff, made("UNRESOLVED", "episode_cutoff")).otherwise(made("CANCELLED", None, recovery, origin)))
        .when(~category.isin("ordinary", "diverted_reached", "diverted_stranded", "diverted_unknown"), made("UNRESOLVED", "unclassified_historical_outcome"))
        .when(departure < ready, made("MISSED_BOARDING", None, scheduled, origin))
        .when(wrong, made("UNRESOLVED", "contradictory_historical_timeline"))
        .when(late & diverted & (F.size(before) > 0), made("DIVERTED", "episode_cutoff", None, None, before))
        .when(late, made("UNRESOLVED", "episode_cutoff"))
        .when((category == "ordinary") & (departure.isNull() | arrival.isNull()), made("UNRESOLVED", "missing_flight_timing"))
        .when(category == "ordinary", made("ARRIVED", None, arrival, destination))
        .when(reached, made("DIVERTED", None, arrival, destination, valid))
        .otherwise(made("DIVERTED", F.when(complete, "missing_diversion_gate_timing").otherwise("incomplete_diversion_evidence"), None, last, valid))
    )


def buffer_after(status: Column) -> Column:
    return F.when(status == "CANCELLED", 0).when(status == "MISSED_BOARDING", MISSED_BUFFER).otherwise(NEXT_BUFFER)


def departures(offers: DataFrame, requests: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Offers of each request: from its airport, with ready <= departure < until, without those attempted.

    A request is asked once for each day of its window, so that the join's key is (airport, day) and no task holds all departures of an airport.
    """
    day = lambda minute: F.floor(minute / 1440)
    asked = requests.withColumn("_day", F.explode(F.sequence(day(F.col("ready")), F.greatest(day(F.col("ready")), day(F.col("until") - 1)))))
    dated = offers.withColumn("_on", day(F.col("departure")))
    found = asked.join(dated, (asked["airport"] == dated["origin"]) & (asked["_day"] == dated["_on"]) & (dated["departure"] >= asked["ready"]) & (dated["departure"] < asked["until"])).drop("_day", "_on")
    if attempted is not None:
        found = found.join(attempted, ["episode_id", "service_id"], "left_anti")
    return found


def page(found: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The first size rows by (departure, service_id), after a cursor if there is one."""
    if not 1 <= size <= 10_000:
        raise ValueError("page size")
    if after is not None:
        found = found.where(F.struct("departure", "service_id") > F.struct(F.lit(after[0]).alias("departure"), F.lit(after[1]).alias("service_id")))
    return found.orderBy("departure", "service_id").limit(size)


def paged(found: DataFrame, size: int, query: str, cursor: tuple | None = None) -> tuple[list, bool, tuple | None]:
    """(rows, complete, next cursor) of a page: a cursor is (digest of its query, departure, service_id) and good for that query only."""
    if cursor is not None and cursor[0] != query:
        raise ValueError("the cursor belongs to another query")
    got = page(found, min(size + 1, 10_000), None if cursor is None else cursor[1:]).collect() if size < 10_000 else page(found, size, None if cursor is None else cursor[1:]).collect()
    complete, rows = len(got) <= size, got[:size]
    return rows, complete, None if complete else (query, rows[-1]["departure"], rows[-1]["service_id"])


def greedy(offers: DataFrame) -> DataFrame:
    """One offer per episode: to the destination first, then by arrival, departure and id."""
    rank = F.struct((F.col("destination") != F.col("goal")).alias("detour"), "arrival", "departure", "service_id")
    return offers.groupBy("episode_id").agg(F.min(F.struct(rank.alias("rank"), F.struct(*[F.col(c) for c in offers.columns]).alias("row"))).alias("b")).select("b.row.*")


def greedy_encoded(slots: DataFrame) -> DataFrame:
    """The slot that the agent on encoded observations takes: to the destination first, then by arrival, departure and slot; slots: (episode_id, slot, direct, arrival, departure)."""
    return slots.groupBy("episode_id").agg(F.min_by("slot", F.struct((-F.col("direct").cast("int")).alias("d"), "arrival", "departure", "slot")).alias("slot"))


def random_offer(offers: DataFrame, seed: int) -> DataFrame:
    """One offer per episode, each as likely: the least seeded hash of (episode, service)."""
    rank = F.struct(F.xxhash64(F.lit(seed), "episode_id", "service_id").alias("h"), "service_id")
    return offers.groupBy("episode_id").agg(F.min_by(F.struct(*[F.col(c) for c in offers.columns]), rank).alias("row")).select("row.*")


def ended(status: Column, reason: Column, next_decision: Column, airport: Column, goal: Column, cutoff: Column) -> Column:
    """Why a trip is over after a step; null if it goes on. A step without a next decision comes first, then the destination, then time."""
    return (
        F.when(next_decision.isNull(), F.when(reason == "episode_cutoff", "time_limit").when(status == "DIVERTED", "unresolved_diversion_timing").otherwise("unresolved_outcome"))
        .when(status.isin("ARRIVED", "DIVERTED") & (airport == goal), "destination_reached")
        .when(next_decision >= cutoff, "time_limit")
    )


def rollout(requests: DataFrame, offers: DataFrame, scratch, max_decisions: int = 4, minutes: int = 1440, choose=greedy) -> tuple[DataFrame, DataFrame]:
    """Trips played to their end: (episode_id, reason, airport, at, decisions, cancellations, diversions, missed, reward), and their steps.

    requests: (episode_id, airport, goal, start, deadline); offers: (service_id, origin, destination, departure, arrival, category,
    actual_departure, actual_arrival), in minutes, with stops and landings if flights divert. A round is one plan over the trips that go on, and ends
    in written tables; max_decisions bounds the rounds. Trips that are over are written once and not read again.
    A trip ends for the time limit if it could not board before the cutoff, for want of flights only if it could.
    """
    if "stops" not in offers.columns:
        offers = offers.withColumns({"stops": F.array().cast(STOP), "landings": F.lit(None).cast("int")})
    zero = F.lit(0)
    state = requests.select(
        "episode_id", "airport", "goal", "start", "deadline", F.col("start").alias("decision"), F.lit(FIRST_BUFFER).alias("buffer"), (F.col("start") + minutes).alias("until"),
        F.array().cast("array<string>").alias("attempted"), *[zero.alias(c) for c in ("cancellations", "diversions", "missed")],
    )
    done, steps, columns = [], [], [*state.columns]
    state = scratch.cut(state)
    for turn in range(max_decisions + 1):
        asked = state.withColumn("ready", F.col("decision") + F.col("buffer"))
        out_of_time = F.when(F.lit(turn == max_decisions), "decision_limit").when(F.col("ready") >= F.col("until"), "time_limit")
        if turn == max_decisions:
            done.append(scratch.cut(asked.withColumn("reason", out_of_time).select(*columns, "reason")))
            break
        found = departures(offers, asked.where(F.col("ready") < F.col("until"))).where(~F.array_contains("attempted", F.col("service_id")))
        chosen = choose(found.select("episode_id", "goal", "service_id", *[c for c in offers.columns if c not in ("service_id",)], "ready", "decision", "until"))
        made = transition(
            F.col("category"), F.col("actual_departure"), F.col("actual_arrival"), F.col("departure"), F.col("ready"), F.col("decision"), F.col("until"), F.col("stops"), F.col("landings"), F.col("origin"), F.col("destination")
        )
        step = scratch.cut(chosen.select("episode_id", F.lit(turn).alias("step"), F.col("origin").alias("from"), "decision", "ready", "service_id", made.alias("t")).select("episode_id", "step", "from", "decision", "ready", "service_id", "t.*"))
        steps.append(step)
        after = asked.drop("ready").join(step.select("episode_id", "service_id", "ready", "status", F.col("reason").alias("why"), "next_decision", F.col("airport").alias("to")), "episode_id", "left")
        status = F.col("status")
        over = ended(status, F.col("why"), F.col("next_decision"), F.col("to"), F.col("goal"), F.col("until"))
        none = F.when(F.col("decision") + F.col("buffer") >= F.col("until"), "time_limit").otherwise("no_feasible_flights")
        add = lambda c, x: (F.col(c) + F.when(status == x, 1).otherwise(0)).alias(c)
        moved = after.withColumn("reason", F.when(status.isNull(), none).otherwise(over)).select(
            "episode_id", F.when(status.isNull(), F.col("airport")).otherwise(F.col("to")).alias("airport"), "goal", "start", "deadline",
            F.when(F.col("reason") == "time_limit", F.col("until")).otherwise(F.coalesce("next_decision", "decision")).cast("long").alias("decision"),
            F.when(status.isNull(), F.col("buffer")).otherwise(buffer_after(status)).alias("buffer"), "until",
            F.when(status.isNull(), F.col("attempted")).otherwise(F.concat("attempted", F.array("service_id"))).alias("attempted"),
            add("cancellations", "CANCELLED"), add("diversions", "DIVERTED"), add("missed", "MISSED_BOARDING"), "reason",
        )
        moved = scratch.cut(moved)
        done.append(moved.where("reason is not null"))
        state = moved.where("reason is null").drop("reason")
    every, all_steps = done[0], steps[0]
    for more in done[1:]:
        every = every.unionByName(more)
    for more in steps[1:]:
        all_steps = all_steps.unionByName(more)
    score = reward(F.col("reason"), F.col("decision"), F.col("deadline"), F.col("cancellations"), F.col("diversions"), F.col("missed"))
    return every.withColumn("decisions", F.size("attempted")).withColumn("reward", score), all_steps


def verify_steps(requests: DataFrame, offers: DataFrame, steps: DataFrame, minutes: int = 1440) -> DataFrame:
    """(episode_id, step, field) of stored steps that do not follow from the request, the offers and the steps before them.

    Nothing of the rollout's own state is used: each step's place, decision and buffer come from the step before by a window over the episode, its
    outcome from the offer, and its choice from all departures that it had.
    """
    if "stops" not in offers.columns:
        offers = offers.withColumns({"stops": F.array().cast(STOP), "landings": F.lit(None).cast("int")})
    from pyspark.sql import Window as W

    by = W.partitionBy("episode_id").orderBy("step")
    known = steps.join(requests.select("episode_id", F.col("airport").alias("first"), "goal", "start"), "episode_id", "left")
    told = known.withColumns({"was": F.lag("status").over(by), "before": F.collect_list("service_id").over(by.rowsBetween(W.unboundedPreceding, -1)), "number": F.row_number().over(by) - 1, "place": F.lag("airport").over(by), "at": F.lag("next_decision").over(by)})
    told = told.withColumns({
        "x_from": F.when(F.col("number") == 0, F.col("first")).otherwise(F.col("place")), "x_decision": F.when(F.col("number") == 0, F.col("start")).otherwise(F.col("at")), "until": F.col("start") + minutes,
    }).withColumn("x_ready", F.col("x_decision") + F.when(F.col("number") == 0, FIRST_BUFFER).otherwise(buffer_after(F.col("was"))))
    asked = told.select(F.concat_ws("#", "episode_id", "step").alias("episode_id"), F.col("x_from").alias("airport"), "goal", F.col("x_ready").alias("ready"), "until", "before")
    best = greedy(departures(offers, asked).where(~F.array_contains("before", F.col("service_id"))).select("episode_id", "goal", "service_id", "destination", "departure", "arrival"))
    named = told.withColumn("id", F.concat_ws("#", "episode_id", "step")).join(best.select(F.col("episode_id").alias("id"), F.col("service_id").alias("x_service_id")), "id", "left")
    chosen = offers.select("service_id", *[F.col(c).alias(f"o_{c}") for c in offers.columns if c != "service_id"])
    o = lambda c: F.col(f"o_{c}")
    outcome = transition(o("category"), o("actual_departure"), o("actual_arrival"), o("departure"), F.col("x_ready"), F.col("x_decision"), F.col("until"), o("stops"), o("landings"), o("origin"), o("destination"))
    full = named.join(chosen, "service_id", "left").withColumn("x", outcome)
    same = {"step": ("step", "number"), "from": ("from", "x_from"), "decision": ("decision", "x_decision"), "ready": ("ready", "x_ready"), "service_id": ("service_id", "x_service_id")}
    same |= {c: (c, f"x.{c}") for c in ("status", "reason", "next_decision", "airport")}
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"`{a}`").eqNullSafe(F.col(b)), F.lit(f)) for f, (a, b) in same.items()]))
    return full.select("episode_id", "step", F.explode(wrong).alias("field"))


def reward(reason: Column, at: Column, deadline: Column, cancellations: Column, diversions: Column, missed: Column) -> Column:
    """60 for arriving, 25 for arriving by the deadline, 10 without disruption, 5 for ending within the limit; of 100."""
    there = reason == "destination_reached"
    points = (
        F.when(there, 60).otherwise(0) + F.when(there & (at <= deadline), 25).otherwise(0)
        + F.when((cancellations + diversions + missed) == 0, 10).otherwise(0) + F.when(reason.isin("destination_reached", "time_limit", "no_feasible_flights", "decision_limit"), 5).otherwise(0)
    )
    return points / 100


def mismatches(stored: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """(key, field) of fields that differ between a stored table and one computed again; rows on one side only differ in all fields."""
    fields = [c for c in stored.columns if c != key]
    a, b = stored.alias("a"), computed.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull(), F.lit(c)) for c in fields]))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(differ).alias("field"))

import glob
import os

import duckdb
import pandas as pd
import pytest

from skyledger import queries as Q

SF = "/root/testdata/sf0.001"


def canonical(df):
    text = lambda x: "null" if not hasattr(x, "__len__") and pd.isna(x) else str(x)[:10] if hasattr(x, "year") else str(bool(x)) if isinstance(x, bool) or getattr(x, "dtype", None) == bool else f"{float(x):.9g}" if not hasattr(x, "__len__") else x if isinstance(x, str) else str(list(x))
    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["service_resolution", "alias_conflicts", "service_pk", "pool_assignment", "pool_membership_hash", "uniform_draw", "transition_outcomes", "greedy_offer", "quality_flag_counts", "record_violations", "verify_rollout", "raw_cell_issues", "raw_null_counts", "raw_time_facts", "raw_airports", "raw_stops"])
def test_query_matches_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def play(request, by_origin, max_decisions=4, minutes=1440):
    """One trip in plain Python, without diversion stops: the rules of rollout, step by step."""
    at, airport, buffer, seen, counts = request["start"], request["airport"], 60, [], {"CANCELLED": 0, "DIVERTED": 0, "MISSED_BOARDING": 0}
    cutoff, reason = request["start"] + minutes, None
    while reason is None:
        ready = at + buffer
        if len(seen) >= max_decisions:
            reason = "decision_limit"
            break
        if ready >= cutoff:
            reason, at = "time_limit", cutoff
            break
        offers = [o for o in by_origin.get(airport, ()) if ready <= o["departure"] < cutoff and o["service_id"] not in seen]
        if not offers:
            reason = "no_feasible_flights"
            break
        o = min(offers, key=lambda o: (o["destination"] != request["goal"], o["arrival"], o["departure"], o["service_id"]))
        seen.append(o["service_id"])
        left, landed, after, to, why = o["actual_departure"], o["actual_arrival"], None, None, None
        known = [t for t in (left, landed) if t is not None]
        if o["category"] == "cancelled":
            status = "UNRESOLVED" if left is not None or o["departure"] + 60 > cutoff else "CANCELLED"
            why = "episode_cutoff" if left is None and status == "UNRESOLVED" else None
            after, to = (o["departure"] + 60, airport) if status == "CANCELLED" else (None, None)
        elif o["category"] == "unknown":
            status = "UNRESOLVED"
        elif left is not None and left < ready:
            status, after, to = "MISSED_BOARDING", o["departure"], airport
        elif known != sorted(known) or any(t < at for t in known) or (len(known) == 2 and landed <= left):
            status = "UNRESOLVED"
        elif any(t > cutoff for t in known):
            status, why = "UNRESOLVED", "episode_cutoff"
        elif o["category"] == "ordinary":
            status, after, to = ("ARRIVED", landed, o["destination"]) if len(known) == 2 else ("UNRESOLVED", None, None)
        else:
            status = "DIVERTED"
        if status in counts:
            counts[status] += 1
        if after is None:
            reason = "time_limit" if why == "episode_cutoff" else "unresolved_diversion_timing" if status == "DIVERTED" else "unresolved_outcome"
            at = cutoff if reason == "time_limit" else at
        else:
            airport, at, buffer = to, after, {"CANCELLED": 0, "MISSED_BOARDING": 0}.get(status, 45)
            if status == "ARRIVED" and airport == request["goal"]:
                reason = "destination_reached"
            elif at >= cutoff:
                reason, at = "time_limit", cutoff
    there = reason == "destination_reached"
    points = 60 * there + 25 * (there and at <= request["deadline"]) + 10 * (sum(counts.values()) == 0) + 5 * (reason in ("destination_reached", "time_limit", "no_feasible_flights", "decision_limit"))
    return (reason, len(seen), counts["CANCELLED"], counts["DIVERTED"], counts["MISSED_BOARDING"], points / 100)


def test_rollout_matches_plain_python(spark):
    requests, offers, scores, steps = Q._rolled(spark, SF)
    by_origin = {}
    for o in offers.collect():
        by_origin.setdefault(o["origin"], []).append(o.asDict())
    got = {r["episode_id"]: (r["reason"], r["decisions"], r["cancellations"], r["diversions"], r["missed"], r["reward"]) for r in scores.collect()}
    want = {r["episode_id"]: play(r.asDict(), by_origin) for r in requests.collect()}
    assert got == want and len(set(r[0] for r in want.values())) >= 4
    assert Q.R.verify_steps(requests, offers, steps).count() == 0


def test_draws_read_services_once(spark, duck):
    got = Q.queries()["empirical_draws"](spark, SF)
    # the levels read written tables, not the line items over and over
    assert not [f for f in got.inputFiles() if f.endswith("lineitem.parquet")]
    assert canonical(got.toPandas()) == canonical(duck.sql(Q.oracle_sql()["empirical_draws"]).df())

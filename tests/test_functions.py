import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from skyledger.functions import facts as T
from skyledger.functions.identity import hex_modulo, uniform_index
from skyledger.functions.scalars import parse_integer
from skyledger.operators.catalog import outcome_category
from skyledger.operators.pools import LEVELS, check_levels
from skyledger.operators.rollout import reward


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


def test_integers(spark):
    raw = ["15.00", "-15.0", "15.7", "NaN", "nonsense", "1e9999", "", None]
    rows = spark.createDataFrame([(x,) for x in raw], "x string").select(parse_integer(F.col("x")).alias("v")).collect()
    assert [r.v for r in rows] == [15, -15, None, None, None, None, None, None]


def scheduled(spark, day, clock, elapsed, arrival, origin, destination):
    f = T.scheduled_departure(F.lit(day).cast("date"), F.lit(clock), F.lit(elapsed), F.lit(arrival), F.lit(origin), F.lit(destination))
    r = one(spark, f.alias("f")).f
    return r.status, r.method, list(r.issues), r.value and int(r.value.replace(tzinfo=timezone.utc).timestamp())


def test_schedule(spark):
    ny, la = "America/New_York", "America/Los_Angeles"
    assert scheduled(spark, "2020-01-01", "2300", 300, "0700", la, ny)[3] == utc(2020, 1, 2, 7)
    assert scheduled(spark, "2020-03-08", "0230", 60, None, ny, ny)[2] == ["nonexistent_local_time"]
    assert scheduled(spark, "2020-11-01", "0130", 60, None, ny, ny)[2] == ["ambiguous_local_time"]
    assert scheduled(spark, "2020-01-01", "2400", 60, None, ny, ny)[2] == ["midnight_date_ambiguous"]
    assert scheduled(spark, "2020-11-01", "0130", 120, "0230", ny, ny)[:2] == ("resolved", "scheduled_fold_disambiguated")


def test_chronology(spark):
    at = lambda *hours: F.array(*[F.timestamp_seconds(F.lit(h * 3600)) for h in hours])
    domains = F.array(at(2, 26), at(1, 3), at(4))
    got = one(spark, F.transform(T.propagate(domains), lambda d: F.transform(d, lambda t: (F.unix_seconds(t) / 3600).cast("int"))).alias("d")).d
    assert got == [[2], [3], [4]]
    gone = one(spark, T.propagate(F.array(at(5), at(3))).alias("d")).d
    assert gone == [[], []]


def test_draw(spark):
    key = '{"seed":4}'
    want = int(hashlib.sha256(json.dumps(["v", {"seed": 4}, 0], separators=(",", ":")).encode()).hexdigest(), 16) % 37
    r = one(spark, uniform_index(F.lit(key), F.lit(37), "v").alias("a"), uniform_index(F.lit(key), F.lit(1), "v").alias("b"), hex_modulo(F.lit("f" * 64), F.lit(1000)).alias("c"))
    assert (r.a, r.b, r.c) == (want, 0, (2**256 - 1) % 1000)
    named = one(spark, uniform_index(F.lit(key), F.lit(37), "sha256-service-rejection-v1").alias("a"))
    assert named.a == 24


def test_categories_and_reward(spark):
    flags = [(True, True, "unknown"), (True, False, "cancelled"), (False, False, "ordinary"), (None, False, "unknown"), (False, True, "diverted_unknown")]
    rows = spark.createDataFrame(flags, "c boolean, d boolean, want string").select(outcome_category(F.col("c"), F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    score = lambda reason, at, c: one(spark, reward(F.lit(reason), F.lit(at), F.lit(100), F.lit(c), F.lit(0), F.lit(0)).alias("r")).r
    assert [score("destination_reached", 90, 0), score("destination_reached", 110, 0), score("time_limit", 90, 0), score("unresolved_outcome", 90, 0), score("decision_limit", 90, 1)] == [1.0, 0.75, 0.15, 0.1, 0.05]


def test_levels():
    check_levels(LEVELS, 30, 6)
    for bad in ((LEVELS, 0, 6), (LEVELS, 1, 7), (LEVELS[:-1], 1, 6)):
        try:
            check_levels(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)

import itertools
import json
import zipfile
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from skyledger import __main__ as cli
from skyledger.operators import airports as A
from skyledger.operators import normalize as N
from skyledger.operators import services as S
from skyledger.sources import archives, snapshot

BASE = {
    "FlightDate": "2020-01-01", "Origin": "SFO", "OriginAirportID": "14771", "OriginStateName": "California", "Dest": "JFK", "DestAirportID": "12478", "DestStateName": "New York",
    "Marketing_Airline_Network": "UA", "Operating_Airline": "UA", "Flight_Number_Marketing_Airline": "0012", "Flight_Number_Operating_Airline": "0012", "Cancelled": "0", "Diverted": "0", "DivAirportLandings": "0",
    "CRSDepTime": "0800", "CRSArrTime": "1600", "CRSElapsedTime": "300", "DepDelay": "15", "ArrDelay": "15", "ActualElapsedTime": "300", "DepTime": "0815", "ArrTime": "1615", "Duplicate": "N", "Year": "2020", "Month": "1",
}
AIRPORTS = [("iata", "SFO", "US", "San Francisco", "KSFO", "California", "America/Los_Angeles"), ("iata", "JFK", "US", "Kennedy", "KJFK", "New York", "America/New_York"), ("iata", "ORD", "US", "O'Hare", "KORD", "Illinois", "America/Chicago")]
HEADERS = list(dict.fromkeys([*BASE, *archives.REQUIRED, *[f"Div{i}{f}" for i in range(1, 6) for f in N.STOP_FIELDS]]))


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


def write_zip(path, rows, headers=HEADERS, extra="", members=("rows.csv",)):
    lines = [",".join(quoted(h) for h in headers) + extra] + [",".join(quoted({**BASE, **r}.get(h.strip(), "")) for h in headers) + extra for r in rows]
    with zipfile.ZipFile(path, "w") as z:
        for m in members:
            z.writestr(m, "﻿" + "\r\n".join(lines) + "\r\n")
    return str(path)


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(AIRPORTS, "kind string, code string, country string, name string, icao string, state string, zone string")


@pytest.fixture(scope="module")
def no_overrides(spark):
    return spark.createDataFrame([], "airport_id long, code string, time_zone string, source string, valid_from date, valid_to date")


@pytest.fixture(scope="module")
def normalized(spark, reference, no_overrides, tmp_path_factory):
    def run(*rows, **kw):
        path = write_zip(tmp_path_factory.mktemp("zip") / "a.zip", rows, **kw)
        return [r for r in N.normalize(N.widen(archives.read_archives(spark, path)), reference, no_overrides).orderBy("ordinal").collect()]

    return run


def test_archives(spark, tmp_path):
    path = write_zip(tmp_path / "a.zip", [{}, {"Duplicate": "a\nb"}, {"DepDelay": " 7 "}], headers=[h + " " for h in HEADERS], extra=",")
    rows = archives.read_archives(spark, path).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [1, 2, 3] and rows[1].cells["Duplicate"] == "a\nb" and rows[2].cells["DepDelay"] == " 7 " and "" not in rows[0].cells and rows[0].member == "rows.csv"
    bad = {
        "two": write_zip(tmp_path / "two.zip", [{}], members=("a.csv", "b.CSV")), "none": write_zip(tmp_path / "none.zip", []), "repeat": write_zip(tmp_path / "r.zip", [{}], headers=[*HEADERS, "year"]),
        "lacks": write_zip(tmp_path / "l.zip", [{}], headers=HEADERS[3:]), "month": write_zip(tmp_path / "m.zip", [{"FlightDate": "2020-02-01"}]), "flag": write_zip(tmp_path / "f.zip", [{"Cancelled": "2"}]), "text": str(tmp_path / "t.zip"),
    }
    open(bad["text"], "w").write("no zip")
    months = spark.createDataFrame([(p, 2020, 1) for p in (path, *bad.values())], "path string, year int, month int")
    found = {r.path.rsplit("/", 1)[1]: r for r in archives.validate_archives(spark, months).collect()}
    ok = found["a.zip"]
    assert ok.problem is None and (ok.rows, ok.cancelled, ok.diverted, ok.first, ok.dates) == (3, 0, 0, date(2020, 1, 1), [date(2020, 1, 1)])
    assert all(r.problem for name, r in found.items() if name != "a.zip") and len(found) == 8
    for name in ("two", "text"):
        with pytest.raises(Exception):
            archives.read_archives(spark, bad[name]).collect()
    one = spark.createDataFrame([([h.upper() for h in HEADERS if h not in ("Year", "DepTime")],)], "h array<string>")
    assert one.select(archives.missing_columns(F.col("h"))).first()[0] == ["Year", "DepTime"]
    page = spark.createDataFrame([('1 Jan  12345 <a href="/PREZIP/x_1.zip">x</a> 7 <a href="/PREZIP/y.zip">',), ("nothing",)], "html string")
    assert [[(x.name, x.size) for x in r[0]] for r in page.select(archives.listing(F.col("html"))).collect()] == [[("x_1.zip", 12345), ("y.zip", 7)], []]
    assert archives.requested_months(spark, 2020, 2025).count() == 72 and archives.requested_months(spark, 2020, 2021, 3).count() == 2
    for wrong in ((2017, 2020), (2021, 2020), (2020, 2021, 13)):
        with pytest.raises(ValueError):
            archives.requested_months(spark, *wrong)
    state = lambda rows, s: spark.createDataFrame(rows, s)
    entry = "name string, size long, sha256 string"
    got = archives.download_states(state([(x,) for x in "abcdef"], "name string"), state([(x, 5) for x in "abcde"], "name string, size long"), state([("a", 5, "x"), ("b", 5, "x")], entry), state([("a", 5, "x"), ("b", 5, "y"), ("c", 5, "z"), ("d", 6, "z")], entry))
    assert {r.name: r.state for r in got.collect()} == {"a": "verified", "b": "conflict", "c": "adopted", "d": "conflict", "e": "download", "f": "missing"}


def utc(*x):
    return datetime(*x)


def test_normalized_times(normalized):
    a, b, c, d, e = normalized(
        {"FlightDate": "2025-01-02"}, {"CRSDepTime": "2300", "CRSArrTime": "0700", "DepTime": "", "ArrTime": ""}, {"ArrTime": "1600"}, {"Cancelled": "1", "DepDelay": "", "DepTime": ""}, {"OriginStateName": "Nevada", "CRSElapsedTime": "15.7", "Cancelled": "2"},
    )
    values = lambda r: [r[t].value for t in N.TIMES]
    assert values(a) == [utc(2025, 1, 2, 16), utc(2025, 1, 2, 21), utc(2025, 1, 2, 16, 15), utc(2025, 1, 2, 21, 15)] and a.marketing_flight_number == "0012"
    assert values(b)[:2] == [utc(2020, 1, 2, 7), utc(2020, 1, 2, 12)] and b.actual_departure.checks == ["reported_clock_missing"]
    assert c.actual_arrival.status == "contradiction" and c.actual_arrival.issues == ["reported_clock_disagrees"] and c.actual_departure.value == utc(2020, 1, 1, 16, 15)
    assert (d.actual_departure.status, d.actual_arrival.method, d.endpoint, d.endpoint_status) == ("not_applicable", "cancelled_no_arrival", "SFO", "cancelled_at_origin")
    assert e.quality_flags == ["origin_mapping_conflict"] and [(i.field, i.code, i.raw_value) for i in e.cell_issues] == [("CRSElapsedTime", "invalid_integer", "15.7"), ("Cancelled", "invalid_boolean", "2")] and e.outcome_category == "unknown"


def test_daylight_saving(normalized):
    rows = {"Origin": "JFK", "OriginStateName": "New York", "Dest": "JFK", "DepTime": "", "ArrTime": "", "CRSArrTime": ""}
    gap, fold, midnight, told = normalized({**rows, "FlightDate": "2020-03-08", "CRSDepTime": "0230"}, {**rows, "FlightDate": "2020-11-01", "CRSDepTime": "0130"}, {**rows, "CRSDepTime": "2400"}, {**rows, "FlightDate": "2020-11-01", "CRSDepTime": "0130", "CRSArrTime": "0230", "CRSElapsedTime": "120"})
    assert [r.scheduled_departure.issues for r in (gap, fold, midnight)] == [["nonexistent_local_time"], ["ambiguous_local_time"], ["midnight_date_ambiguous"]] and len(fold.scheduled_departure.evidence) == 2
    assert (told.scheduled_departure.value, told.scheduled_arrival.value, told.scheduled_departure.method) == (utc(2020, 11, 1, 5, 30), utc(2020, 11, 1, 7, 30), "scheduled_fold_disambiguated")
    assert gap.scheduled_arrival.method == "scheduled_elapsed"


def plain_stops(clocks, lower, upper):
    """Statuses and values of stop clocks by enumeration of days and minutes."""
    domains = []
    for clock, zone in clocks:
        z, found = ZoneInfo(zone), []
        for day in range(-1, 4):
            wall = datetime(lower.year, lower.month, lower.day) + timedelta(days=day, hours=int(clock[:2]), minutes=int(clock[2:]))
            for fold in (0, 1):
                t = wall.replace(tzinfo=z, fold=fold).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
                if lower <= t <= upper and t not in found:
                    found.append(t)
        domains.append(sorted(found))
    before = list(domains)
    for order, keep in ((range(len(domains)), lambda t, e: t >= e), (range(len(domains) - 1, -1, -1), lambda t, e: t <= e)):
        edge = None
        for i in order:
            if domains[i]:
                domains[i] = [t for t in domains[i] if edge is None or keep(t, edge)]
                if domains[i]:
                    edge = domains[i][0] if order.step > 0 else domains[i][-1]
    lost = any(a and not b for a, b in zip(before, domains))
    return [("contradiction", None) if lost and d else ("resolved", d[0]) if len(d) == 1 else ("unresolved", None) for d in domains]


def test_diversion_stops(normalized):
    base = {"Diverted": "1", "DivReachedDest": "1", "ArrTime": "", "DivActualElapsedTime": "900", "DivAirportLandings": "2"}
    cases = list(itertools.islice(itertools.product(("1200", "2000", "2359"), ("1300", "0100"), ("1500", "0930"), ("1600", "0830")), 24))
    stop = lambda i, code, id_, on, off: {f"Div{i}Airport": code, f"Div{i}AirportID": id_, f"Div{i}WheelsOn": on, f"Div{i}WheelsOff": off}
    rows = normalized(*[{**base, **stop(1, "ORD", "13930", a, b), **stop(2, "SFO", "14771", c, d)} for a, b, c, d in cases])
    lower, kinds = utc(2020, 1, 1, 16, 15), set()
    for r, (a, b, c, d) in zip(rows, cases):
        want = plain_stops([(a, "America/Chicago"), (b, "America/Chicago"), (c, "America/Los_Angeles"), (d, "America/Los_Angeles")], lower, lower + timedelta(minutes=900))
        got = [(f.status, f.value) for s in r.stops for f in (s.landing, s.departure)]
        assert got == want, (a, b, c, d)
        kinds |= {k for k, _ in got}
    assert kinds >= {"resolved", "contradiction"}
    stranded, odd, early = normalized({**base, **stop(1, "ORD", "13930", "", ""), "DivAirportLandings": "1", "DivReachedDest": "0"}, {**stop(2, "XXX", "x", "1", "2")}, {**base, **stop(1, "ORD", "13930", "1200", "9999"), "DivActualElapsedTime": ""})
    assert (stranded.endpoint, stranded.endpoint_status, stranded.quality_flags) == ("ORD", "reported_final_diversion_stop", []) and stranded.stops[0].landing.issues == ["stop_clock_missing"]
    assert odd.quality_flags == ["diversion_mapping_unresolved", "diversion_stops_without_diversion_flag"] and odd.stops[0].stop_index == 2
    assert early.stops[0].landing.issues == ["missing_time_anchor"] and early.stops[0].departure.issues == ["invalid_stop_clock"] and "incomplete_diversion_stop_sequence" in early.quality_flags


def test_airports(spark, reference):
    overrides = spark.createDataFrame([(1, "ZZZ", "UTC", "letter", date(2020, 1, 1), date(2020, 6, 30)), (1, "ZZZ", "Pacific/Honolulu", "letter 2", date(2020, 7, 1), date(2021, 1, 1))], "airport_id long, code string, time_zone string, source string, valid_from date, valid_to date")
    A.check_overrides(overrides)
    with pytest.raises(ValueError):
        A.check_overrides(overrides.unionByName(overrides))
    with pytest.raises(ValueError):
        A.check_overrides(overrides.withColumn("valid_to", F.lit(date(2019, 1, 1))))
    more = reference.unionByName(spark.createDataFrame([("lid", "SFO", "US", "no", "", "", "UTC"), ("lid", "0A1", "US", "Grass", "", "Texas", None), ("lid", "C01", "CA", "Lake", "", "", "UTC")], reference.schema))
    asked = [(1, "zzz ", date(2020, 3, 1), None), (1, "ZZZ", date(2020, 7, 1), "x"), (1, "ZZZ", None, None), (2, "ZZZ", date(2020, 3, 1), None), (3, "sfo", None, "CALIFORNIA"), (3, "SFO", None, "Ohio"), (4, "0A1", None, None), (5, "C01", None, None), (None, None, None, None)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, id long, code string, day date, state string")
    got = {r.i: r.m for r in A.resolve(rows, "id", "code", "day", F.col("state"), more, overrides, "m").collect()}
    assert [(got[i].time_zone, got[i].status, got[i].method) for i in range(9)] == [
        ("UTC", "resolved", "reviewed_override"), ("Pacific/Honolulu", "resolved", "reviewed_override"), (None, "unmapped", "none"), (None, "unmapped", "none"), ("America/Los_Angeles", "resolved", "exact_iata"),
        (None, "conflict", "exact_iata"), (None, "unmapped", "exact_us_faa_lid"), (None, "unmapped", "none"), (None, "unmapped", "none"),
    ]


def test_services(spark, reference, no_overrides, tmp_path):
    rows = [{}, {"Marketing_Airline_Network": "XX"}, {"FlightDate": "2020-01-02", "Duplicate": "Y"}, {"FlightDate": "2020-01-03"}, {"FlightDate": "2020-01-03", "Cancelled": "1"}, {"FlightDate": "2020-01-04"}, {"FlightDate": "2020-01-04", "CRSElapsedTime": "310", "CRSArrTime": "1610"}, {"FlightDate": "2020-01-05"}, {"FlightDate": "2020-01-05", "Operating_Airline": "XX"}, {"Operating_Airline": ""}]
    path = write_zip(tmp_path / "a.zip", rows)
    flights = N.normalize(N.widen(archives.read_archives(spark, path)), reference, no_overrides)
    root = snapshot.publish(flights, reference, f"file://{tmp_path}/out", {"v": 1}, [2020], [])
    stored = spark.read.parquet(f"{root}/flights")
    found = S.candidates(stored)
    services, left = S.resolve(found)
    got = {(r.flight_date.day, r.operating_carrier): r for r in services.collect()}
    assert len(got) == 6 and got[1, "UA"].rows == 2 and not got[1, "UA"].evidence_conflict and got[3, "UA"].evidence_conflict and not got[3, "UA"].schedule_conflict and got[4, "UA"].schedule_conflict
    assert {r.reason: r.rows for r in left.collect()} == {"missing_service_identity": 1}
    shared = S.aliases(found).groupBy("alias").agg(F.count("*").alias("n"), F.collect_set("service_id").alias("s")).where("n > 1").collect()
    assert [set(x.s) for x in shared] == [{got[5, "UA"].service_id, got[5, "XX"].service_id}]
    assert {r.service_id: len(r.records) for r in S.supports(found, services).collect()}[got[1, "UA"].service_id] == 2
    assert S.tampered(services, stored).count() == 0 and S.tampered(services, stored.withColumn("operating_flight_number", F.lit("9"))).count() == 6
    assert S.flight_option(services, got[1, "UA"].service_id).arrival == utc(2020, 1, 1, 21)
    with pytest.raises(KeyError):
        S.flight_option(services, "x")
    one, conflicting = services.where("rows = 2 and not schedule_conflict and not evidence_conflict"), spark.createDataFrame([], "service_id string")
    assert S.ready(one, conflicting, "review") and not S.ready(one, conflicting, None) and not S.ready(services, conflicting, "review") and not S.ready(one, one.select("service_id"), "review")
    capped, diagnostics = S.resolve(found, max_group=1)
    assert capped.count() == 3 and {r.reason: r.rows for r in diagnostics.collect()}["oversized_group"] == 6


def test_snapshot(spark, reference, no_overrides, tmp_path, capsys):
    path = write_zip(tmp_path / "a.zip", [{}, {"FlightDate": "2020-02-02", "Diverted": "1", "Div1Airport": "ORD", "Div1AirportID": "13930", "DivAirportLandings": "1"}, {"FlightDate": "2025-01-01"}])
    reference.write.parquet(f"{tmp_path}/airports")
    args = ["normalize", path, "--reference", f"{tmp_path}/airports", "--output", f"file://{tmp_path}/out", "--historical", "2020", "--evaluation", "2025"]
    assert cli.main(args) == 0 and cli.main(args) == 0  # the second one finds the first
    root = capsys.readouterr().out.split()[-1]
    assert cli.main(["verify", root]) == 0 and cli.main(["report", root]) == 0
    assert {r["outcome_category"]: r["count"] for r in json.loads(capsys.readouterr().out.splitlines()[-1])["categories"]} == {"ordinary": 2, "diverted_unknown": 1}
    store = snapshot.Store(spark, root)
    assert store.manifest["totals"] == {"rows": 3, "cancelled": 0, "diverted": 1} and store.manifest["inventories"]["historical"] == ["2020-01", "2020-02"] and store.manifest["inventories"]["unassigned"] == []
    refs = store.source_refs("historical").collect()
    assert [r.ordinal for r in refs] == [1, 2] and store.of("evaluation").count() == 1 and store.of("unassigned").count() == 0
    assert [s.airport for s in store.get(refs[0].sha256, 2, ["historical"]).table_stops] == ["ORD"]
    with pytest.raises(PermissionError):
        store.get(refs[0].sha256, 3, ["historical"])
    with pytest.raises(KeyError):
        store.get(refs[0].sha256, 9)
    with pytest.raises(ValueError):
        snapshot.Store(spark, root, "another")
    spark.read.parquet(f"{root}/stops").withColumn("airport", F.lit("LAX")).write.parquet(f"{root}-2")
    store_path = snapshot.Folder(spark, root)
    store_path.drop("stops")
    assert store_path.fs.rename(store_path.at(f"{root}-2"), store_path.at(f"{root}/stops"))
    with pytest.raises(ValueError):
        snapshot.verify(spark, root)
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            snapshot.strict_json(text)
    with pytest.raises(ValueError):
        store_path.inside("../x")
    with pytest.raises(Exception):
        store_path.write_json(snapshot.MANIFEST, {})
    with pytest.raises(ValueError):
        snapshot.inventories([], [2020], [2020])
    assert cli.periods(["2020-02", "2020-01"]) == [(2020, 1), (2020, 2)]
    with pytest.raises(ValueError):
        cli.periods(["2020-13"])


def test_airports_are_looked_up_without_a_shuffle_of_flights(spark):
    from skyledger.plans.raw_view import overrides, reference

    rows = spark.sql("select id, 'AP' || id % 6 as code, date'1995-06-01' as day from range(20)")
    got = A.resolve(rows, "id", "code", "day", None, reference(spark), overrides(spark), "m")
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.code: r.m.status for r in got.collect()} == {f"AP{i}": "unmapped" if i in (4, 5) else "resolved" for i in range(6)}


@pytest.fixture(scope="module")
def raw_flights(spark):
    from skyledger import queries  # noqa: F401  it registers the others
    from skyledger.raw_queries import flights_of

    return flights_of(spark, "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_of_a_fact_is_read_without_the_others(raw_flights):
    plan = plan_of(raw_flights.select("actual_arrival.status"))
    assert "both_agree" not in plan and "arrival_paths_agree" not in plan and "contradiction" in plan


def test_flights_that_tell_the_same_are_counted_before_they_are_taken_apart(raw_flights):
    plan = plan_of(N.fact_counts(raw_flights, kinds=("issue",)))
    assert "Aggregate" in plan[plan.index("Generate"):] and "reported_clock_agrees" not in plan


def test_line_items_are_dealt_once(spark):
    from skyledger.plans.flight_view import flights

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = flights(spark, "/root/testdata/sf0.001").select("l_orderkey", "origin", "destination")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_" in line]
    assert len(dealt) == 1 and "l_orderkey" in dealt[0]


def test_flags_are_found_without_times(raw_flights):
    assert "to_utc_timestamp" not in plan_of(raw_flights.select("quality_flags"))


def test_endpoints_are_found_without_times_or_airports(raw_flights):
    plan = plan_of(raw_flights.select("endpoint_status", "endpoint_airport_id"))
    assert "to_utc_timestamp" not in plan and "_mapping" not in plan


def test_groups_are_counted_without_digests(spark):
    rows = [(None, 1, "A", "1", 1), (None, 1, "A", "1", 1), (None, 1, "A", None, 2), ("invalid_schedule", 2, "B", "2", 1), ("invalid_schedule", 3, "B", "2", 2)]
    found = spark.createDataFrame(rows, "exclusion string, m long, operating_carrier string, operating_flight_number string, origin_airport_id long")
    found = found.selectExpr("*", "date'2020-01-01' flight_date", "2L destination_airport_id", "named_struct('value', timestamp_seconds(60 * m)) scheduled_departure")
    counted = S.counted(found)
    assert "sha2" not in plan_of(counted)
    digests = S.with_id(found, S.POLICY).groupBy("exclusion", "service_id").count()
    assert sorted(map(str, (tuple(r) for r in counted.collect()))) == sorted(str((r["exclusion"], r["count"])) for r in digests.collect()) and len(counted.collect()) == 3


def test_rows_without_cells_of_stops_have_no_stops(spark):
    rows = [{}, {"Div3WheelsOff": "x"}, {"Div1Airport": "  "}, {"Div5AirportID": "7"}]
    names = N.SOURCE_COLUMNS
    raw = spark.createDataFrame([("p", "a", "m", i, *[{**BASE, **r}.get(c, "") for c in names]) for i, r in enumerate(rows)], "path string, sha256 string, member string, ordinal long, " + ", ".join(f"{c} string" for c in names))
    want = [r.ordinal for r in N.parse_cells(raw).where("size(stops) > 0").collect()]
    assert sorted(r.ordinal for r in raw.where(N.has_stops()).collect()) == sorted(want) == [1, 3]

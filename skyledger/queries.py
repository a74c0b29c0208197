"""Queries over the driver's tables, one or more per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import uniform_index
from .functions.scalars import at_minute, clock_minutes, invalid_integer, local_candidates, normalize_column, parse_boolean, parse_date, parse_integer
from .operators import catalog as C
from .operators import pools as P
from .operators import rollout as R
from .plans.flight_view import FLIGHTS_SQL, flights, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EXCLUDED_SQL = """excluded AS (SELECT *, CASE WHEN origin <= 0 OR destination <= 0 THEN 'invalid_airport_identity'
    WHEN operating_carrier IS NULL OR operating_number IS NULL THEN 'missing_service_identity'
    WHEN flight_date IS NULL OR departure_minute IS NULL THEN 'unresolved_schedule_time'
    WHEN origin = destination OR elapsed <= 0 THEN 'invalid_schedule' END AS exclusion FROM flights),
valid AS (SELECT *, sha256(concat_ws('|', CAST(flight_date AS VARCHAR), operating_carrier, operating_number, CAST(origin AS VARCHAR), CAST(destination AS VARCHAR), CAST(departure_minute AS VARCHAR))) AS service_id
    FROM excluded WHERE exclusion IS NULL)"""
SERVICES_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY marketing_carrier, marketing_number, record_id) AS k FROM valid),
services AS (SELECT service_id, any_value(flight_date) AS flight_date, any_value(operating_carrier) AS operating_carrier, any_value(operating_number) AS operating_number,
    any_value(origin) AS origin, any_value(destination) AS destination, any_value(departure_minute) AS departure_minute, count(*) AS rows,
    count(DISTINCT elapsed) > 1 AS schedule_conflict, count(DISTINCT concat_ws('|', coalesce(CAST(departure_delay AS VARCHAR), 'null'), cancelled, diverted)) > 1 AS evidence_conflict,
    max(CASE WHEN k = 1 THEN marketing_carrier END) AS marketing_carrier, max(CASE WHEN k = 1 THEN record_id END) AS record_id, max(CASE WHEN k = 1 THEN elapsed END) AS elapsed,
    max(CASE WHEN k = 1 THEN departure_delay END) AS departure_delay, max(CASE WHEN k = 1 THEN CAST(cancelled AS INTEGER) END) = 1 AS cancelled, max(CASE WHEN k = 1 THEN CAST(diverted AS INTEGER) END) = 1 AS diverted
    FROM ranked GROUP BY service_id)"""
ALIAS_SQL = """alias AS (SELECT DISTINCT * FROM (SELECT flight_date, origin, departure_minute, operating_carrier AS carrier, operating_number AS number, service_id FROM valid
    UNION ALL SELECT flight_date, origin, departure_minute, marketing_carrier, marketing_number, service_id FROM valid)),
conflicts AS (SELECT flight_date, origin, departure_minute, carrier, number, count(DISTINCT service_id) AS services FROM alias GROUP BY ALL HAVING count(DISTINCT service_id) > 1),
marked AS (SELECT DISTINCT service_id FROM alias JOIN conflicts USING (flight_date, origin, departure_minute, carrier, number))"""
FEATURES_SQL = """features AS (SELECT *, CAST(quarter(flight_date) AS INTEGER) AS quarter, CAST(isodow(flight_date) - 1 AS INTEGER) AS weekday, CAST(departure_minute // 360 AS INTEGER) AS bucket,
    CAST(date_diff('day', DATE '1970-01-01', flight_date) * 1440 + departure_minute AS BIGINT) AS departure FROM services)"""
CATEGORY_SQL = "CASE WHEN cancelled AND diverted THEN 'unknown' WHEN cancelled THEN 'cancelled' WHEN diverted THEN 'diverted_unknown' ELSE 'ordinary' END"
LEVEL_SQL = " UNION ALL ".join(
    f"SELECT {i} AS level, origin, destination, " + ", ".join(f if f in fields else f"NULL AS {f}" for f in P.FIELDS) + ", count(*) AS size FROM history GROUP BY " + ", ".join((*P.ROUTE, *fields)) for i, fields in enumerate(P.LEVELS)
)
POOLS_SQL = f"""history AS (SELECT * FROM features WHERE year(flight_date) <= 2000), targets AS (SELECT * FROM features WHERE year(flight_date) = 2001), sizes AS ({LEVEL_SQL}),
assigned AS (SELECT t.service_id, min(s.level) AS level FROM targets t JOIN sizes s ON t.origin = s.origin AND t.destination = s.destination
    AND (s.level > 2 OR t.operating_carrier = s.operating_carrier) AND (s.level > 3 OR t.quarter = s.quarter)
    AND (s.level > 1 OR t.bucket = s.bucket) AND (s.level > 0 OR t.weekday = s.weekday) WHERE s.size >= 30 OR s.level = 4 GROUP BY 1)"""


def query(sql: str | None = None, *parts: str):
    """Registers a function by its name, with SQL over the common table expressions named in parts."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ",\n".join([FLIGHTS_SQL, *parts]) + "\n" + sql) if parts or "flights" in sql else sql
        return f

    return add


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_exclusion(flights(spark, sf_dir))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_services(excluded(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pool_features(services(spark, sf_dir)).withColumn("departure", F.col("departure_at").cast("long") / 60).withColumn("departure", F.col("departure").cast("long"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("year(flight_date) <= 2000")


@query("SELECT year, count(*) AS n, count_if(cancelled) AS cancelled, count_if(diverted) AS diverted, count(departure_delay) AS delays FROM flights GROUP BY year")
def flights_view_summary(spark, sf_dir):
    return flights(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.count_if("cancelled").alias("cancelled"), F.count_if("diverted").alias("diverted"), F.count("departure_delay").alias("delays"))


@query("SELECT coalesce(exclusion, 'included') AS reason, count(*) AS n FROM excluded GROUP BY 1", EXCLUDED_SQL)
def exclusion_reasons(spark, sf_dir):
    return excluded(spark, sf_dir).groupBy(F.coalesce("exclusion", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM flights GROUP BY 1")
def outcome_category_counts(spark, sf_dir):
    return flights(spark, sf_dir).groupBy(C.outcome_category(F.col("cancelled"), F.col("diverted")).alias("category")).agg(F.count("*").alias("n"))


INTEGERS = ["15.00", "-15.0", "15.7", "NaN", "nonsense", "1e9999", "", " 7 ", "0012", "9223372036854775808", "9223372036854775807", "-0", "+3", "2e3", "."]
CLOCKS = [0, 5, 59, 60, 815, 1300, 2359, 2360, 2400, 2401, -5, 9999]


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}, {b})" for i, (v, b) in enumerate([(15, "false"), (-15, "false"), ("NULL", "true"), ("NULL", "true"), ("NULL", "true"), ("NULL", "true"), ("NULL", "false"), (7, "false"), (12, "false"), ("NULL", "true"), (9223372036854775807, "false"), (0, "false"), (3, "false"), (2000, "false"), ("NULL", "true")])) + ") t(i, value, invalid)")
def parse_integer_matrix(spark, sf_dir):
    raw = F.col("raw")
    return _values(spark, list(enumerate(INTEGERS)), "i int, raw string").select("i", parse_integer(raw).alias("value"), invalid_integer(raw).alias("invalid"))


@query("SELECT v AS clock, CASE WHEN v = 2400 THEN 0 WHEN v < 0 OR v // 100 > 23 OR v % 100 > 59 THEN NULL ELSE (v // 100) * 60 + v % 100 END AS minute FROM (SELECT unnest([" + ", ".join(map(str, CLOCKS)) + "]) AS v)")
def clock_minutes_matrix(spark, sf_dir):
    return _values(spark, [(c,) for c in CLOCKS], "clock int").select("clock", clock_minutes(F.col("clock")).alias("minute"))


@query("SELECT * FROM (VALUES (0, true, DATE '2020-01-01'), (1, false, NULL), (2, NULL, NULL), (3, NULL, NULL)) t(i, flag, day)")
def parse_flag_and_date_matrix(spark, sf_dir):
    rows = _values(spark, [(0, "1.00", "2020-01-01"), (1, "0", "2020-02-30"), (2, "2", "1/1/2020"), (3, None, None)], "i int, flag string, day string")
    return rows.select("i", parse_boolean(F.col("flag")).alias("flag"), parse_date(F.col("day")).alias("day"))


@query("""SELECT * FROM (VALUES ('2020-03-08', 150, 0, NULL::BIGINT, NULL::BIGINT), ('2020-11-01', 90, 2, 1604208600, 1604212200), ('2020-01-01', 480, 1, 1577883600, 1577883600))
    t(day, minute, candidates, first, last)""")
def local_time_candidates(spark, sf_dir):
    rows = _values(spark, [("2020-03-08", 150), ("2020-11-01", 90), ("2020-01-01", 480)], "day string, minute int")
    found = rows.withColumn("c", local_candidates(F.col("day").cast("date"), F.col("minute"), F.lit("America/New_York")))
    return found.select("day", "minute", F.size("c").alias("candidates"), F.unix_seconds(F.array_min("c")).alias("first"), F.unix_seconds(F.array_max("c")).alias("last"))


@query("""SELECT origin, count(*) AS n, CAST(sum(date_diff('day', DATE '1970-01-01', flight_date) * 1440 + departure_minute + elapsed) AS BIGINT) AS arrivals,
    CAST(sum(CASE WHEN departure_delay IS NOT NULL THEN date_diff('day', DATE '1970-01-01', flight_date) * 1440 + departure_minute + departure_delay END) AS BIGINT) AS departures FROM flights GROUP BY origin""")
def schedule_reconstruction(spark, sf_dir):
    from .operators.normalize import time_facts

    text, minutes = F.lit(None).cast("string"), F.lit(None).cast("long")
    clock = F.lpad((F.floor(F.col("departure_minute") / 60) * 100 + F.col("departure_minute") % 60).cast("string"), 4, "0")
    zone = F.struct(F.lit("UTC").alias("time_zone"))
    rows = flights(spark, sf_dir).select(
        "origin", "flight_date", clock.alias("scheduled_departure_clock"), *[text.alias(f"{t}_clock") for t in ("scheduled_arrival", "actual_departure", "actual_arrival")], F.lit("ordinary").alias("outcome_category"),
        F.col("elapsed").alias("scheduled_elapsed_minutes"), F.col("departure_delay").alias("departure_delay_minutes"), zone.alias("origin_mapping"), zone.alias("destination_mapping"),
        *[minutes.alias(f"{t}_minutes") for t in ("arrival_delay", "actual_elapsed", "diversion_elapsed", "diversion_arrival_delay")],
    )
    shown = lambda c: (F.unix_seconds(F.col(f"{c}.value")) / 60).cast("long")
    return time_facts(rows).groupBy("origin").agg(F.count("*").alias("n"), F.sum(shown("scheduled_arrival")).alias("arrivals"), F.sum(shown("actual_departure")).alias("departures"))


@query("""SELECT * FROM (VALUES (0, 'resolved', 600, 'both_agree'), (1, 'resolved', 600, 'elapsed_only'), (2, 'resolved', 600, 'arrival_delay_only'), (3, 'contradiction', NULL, 'two_paths'), (4, 'unresolved', NULL, NULL),
    (5, 'contradiction', NULL, 'elapsed_only')) t(i, status, value, method)""")
def arrival_two_paths(spark, sf_dir):
    from .functions import facts as T

    rows = _values(spark, [(0, 600, 600, 300), (1, 600, None, 300), (2, None, 600, 300), (3, 600, 660, 300), (4, None, None, 300), (5, 600, None, 900)], "i int, a long, b long, d long")
    at = lambda c: F.timestamp_seconds(F.col(c))
    made = T.actual_arrival(at("a"), at("b"), at("d"), F.lit(None).cast("string"), F.lit("UTC"))
    return rows.withColumn("f", made).select("i", "f.status", F.unix_seconds("f.value").cast("int").alias("value"), "f.method")


PROFILED = ["flight_date", "origin", "destination", "operating_carrier", "operating_number", "elapsed", "departure_delay", "cancelled", "diverted"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls FROM flights" for c in PROFILED))
def null_profile(spark, sf_dir):
    counted = flights(spark, sf_dir).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in PROFILED])
    return counted.unpivot([], PROFILED, "field", "nulls")


FLAGS = {"missing_delay": "departure_delay IS NULL", "same_airport": "origin = destination", "cancelled_and_diverted": "cancelled AND diverted", "early": "departure_delay < 0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) AS n FROM flights WHERE {v} HAVING count(*) > 0" for k, v in FLAGS.items()))
def quality_flag_counts(spark, sf_dir):
    flags = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in FLAGS.items()]))))
    return flights(spark, sf_dir).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


CANDIDATE = ("flight_date", "marketing_carrier", "marketing_number", "origin", "destination", "departure_minute")


def _collisions(spark, sf_dir):
    return flights(spark, sf_dir).groupBy(*CANDIDATE).agg(F.count("*").alias("n"), F.min("record_id").alias("first_row")).where("n > 1")


GROUPED_SQL = f"(SELECT count(*) AS n, min(record_id) AS first_row FROM flights GROUP BY {', '.join(CANDIDATE)} HAVING count(*) > 1)"


@query(f"SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM {GROUPED_SQL}, (SELECT 1 FROM flights LIMIT 1)")
def candidate_key_collisions(spark, sf_dir):
    return _collisions(spark, sf_dir).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows"))


@query(f"SELECT first_row, n FROM {GROUPED_SQL} ORDER BY first_row LIMIT 10 -- flights".replace(" -- flights", ""))
def collision_top10(spark, sf_dir):
    return _collisions(spark, sf_dir).select("first_row", "n").orderBy("first_row").limit(10)


@query("SELECT service_id, rows, schedule_conflict, evidence_conflict, marketing_carrier, record_id, elapsed FROM services", EXCLUDED_SQL, SERVICES_SQL)
def service_resolution(spark, sf_dir):
    return services(spark, sf_dir).select("service_id", "rows", "schedule_conflict", "evidence_conflict", "marketing_carrier", "record_id", "elapsed")


@query("SELECT year(flight_date) AS year, count(*) AS services, count_if(rows > 1) AS grouped, count_if(schedule_conflict) AS schedule_conflicts, count_if(evidence_conflict) AS evidence_conflicts FROM services GROUP BY 1", EXCLUDED_SQL, SERVICES_SQL)
def evidence_conflicts(spark, sf_dir):
    return services(spark, sf_dir).groupBy(F.year("flight_date").cast("long").alias("year")).agg(
        F.count("*").alias("services"), F.count_if(F.col("rows") > 1).alias("grouped"), F.count_if("schedule_conflict").alias("schedule_conflicts"), F.count_if("evidence_conflict").alias("evidence_conflicts")
    )


@query("SELECT flight_date, origin, departure_minute, carrier, number, services FROM conflicts", EXCLUDED_SQL, ALIAS_SQL)
def alias_conflicts(spark, sf_dir):
    return C.alias_conflicts(C.aliases(excluded(spark, sf_dir)))


@query("SELECT count(*) AS marked FROM marked", EXCLUDED_SQL, ALIAS_SQL)
def alias_marked_services(spark, sf_dir):
    return C.conflicting_services(C.aliases(excluded(spark, sf_dir))).agg(F.count("*").alias("marked"))


@query("SELECT service_id, row_number() OVER (ORDER BY year(flight_date), month(flight_date), service_id) AS service_pk FROM services", EXCLUDED_SQL, SERVICES_SQL)
def service_pk(spark, sf_dir):
    rows = services(spark, sf_dir).select("service_id", F.year("flight_date").alias("year"), F.month("flight_date").alias("month"))
    return C.number_rows(rows, ["year", "month"], ["service_id"], "service_pk").select("service_id", "service_pk")


@query("SELECT supports, count(*) AS services FROM (SELECT service_id, count(DISTINCT record_id) AS supports FROM valid GROUP BY 1) GROUP BY 1", EXCLUDED_SQL)
def supports_per_service(spark, sf_dir):
    rows = excluded(spark, sf_dir).where("exclusion is null").select(C.service_id().alias("service_id"), "record_id").distinct()
    return rows.groupBy("service_id").agg(F.count("*").alias("supports")).groupBy("supports").agg(F.count("*").alias("services"))


@query("""SELECT CASE WHEN year(flight_date) <= 2000 THEN 'historical' WHEN year(flight_date) = 2001 THEN 'evaluation' ELSE 'unassigned' END AS split, count(*) AS services,
    count_if(NOT schedule_conflict AND m.service_id IS NULL) AS schedule_ready, count_if(NOT schedule_conflict AND NOT evidence_conflict AND m.service_id IS NULL) AS ready
    FROM services s LEFT JOIN marked m ON s.service_id = m.service_id GROUP BY 1""", EXCLUDED_SQL, SERVICES_SQL, ALIAS_SQL)  # fmt: skip
def readiness_by_split(spark, sf_dir):
    rows = excluded(spark, sf_dir)
    marked = C.conflicting_services(C.aliases(rows)).withColumn("aliased", F.lit(True))
    found = C.resolve_services(rows).join(marked, "service_id", "left")
    clean = ~F.col("schedule_conflict") & F.col("aliased").isNull()
    split = C.split_of(F.year("flight_date"), range(1990, 2001), [2001])
    return found.groupBy(split.alias("split")).agg(F.count("*").alias("services"), F.count_if(clean).alias("schedule_ready"), F.count_if(clean & ~F.col("evidence_conflict")).alias("ready"))


@query("SELECT DISTINCT year, month, CASE WHEN year <= 1999 THEN 'historical' WHEN year = 2001 THEN 'evaluation' ELSE 'unassigned' END AS split FROM flights")
def split_assignment(spark, sf_dir):
    return flights(spark, sf_dir).select("year", "month").distinct().withColumn("split", C.split_of(F.col("year"), range(1990, 2000), [2001]))


@query("""SELECT returnflag, min(o) AS first, max(o) AS last FROM (SELECT l_returnflag AS returnflag, o, o - row_number() OVER (PARTITION BY l_returnflag ORDER BY o) AS i
    FROM (SELECT DISTINCT l_returnflag, l_orderkey AS o FROM lineitem)) GROUP BY returnflag, i""")
def ordinal_ranges(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("returnflag"), F.col("l_orderkey").alias("o"))
    return C.ordinal_ranges(rows, ["returnflag"], "o")


WINDOW = (10000, 10227 * 1440, 10229 * 1440)  # 1998-01-01 to 1998-01-03


def _window(spark, sf_dir):
    airport, lo, hi = WINDOW
    return features(spark, sf_dir).where((F.col("origin") == airport) & (F.col("departure") >= lo) & (F.col("departure") < hi)).select("service_id", "departure", "destination")


WINDOW_SQL = f"SELECT service_id, departure, destination FROM features WHERE origin = {WINDOW[0]} AND departure >= {WINDOW[1]} AND departure < {WINDOW[2]}"
SCHEDULE = (EXCLUDED_SQL, SERVICES_SQL, FEATURES_SQL)


@query(WINDOW_SQL, *SCHEDULE)
def departures_window(spark, sf_dir):
    return _window(spark, sf_dir)


@query(f"SELECT * FROM ({WINDOW_SQL}) WHERE departure > {WINDOW[1] + 600} OR (departure = {WINDOW[1] + 600} AND service_id > '7') ORDER BY departure, service_id LIMIT 3", *SCHEDULE)
def departures_page2(spark, sf_dir):
    return R.page(_window(spark, sf_dir), 3, (WINDOW[1] + 600, "7"))


@query(f"SELECT * FROM ({WINDOW_SQL}) WHERE service_id NOT IN (SELECT min(service_id) FROM ({WINDOW_SQL}))", *SCHEDULE)
def departures_excluding_attempted(spark, sf_dir):
    found = _window(spark, sf_dir)
    return found.join(found.agg(F.min("service_id").alias("service_id")), "service_id", "left_anti")


@query("""SELECT origin, min(m) AS first, max(m) AS last FROM (SELECT origin, m, m - row_number() OVER (PARTITION BY origin ORDER BY m) AS i
    FROM (SELECT DISTINCT origin, CAST(year * 12 + month AS BIGINT) AS m FROM flights)) GROUP BY origin, i""")
def coverage_windows(spark, sf_dir):
    return C.ordinal_ranges(flights(spark, sf_dir).select("origin", (F.col("year") * 12 + F.col("month")).cast("long").alias("m")), ["origin"], "m")


@query("SELECT CAST(level AS INTEGER) AS level, count(*) AS pools, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest FROM sizes GROUP BY level", *SCHEDULE, POOLS_SQL)
def pool_level_sizes(spark, sf_dir):
    sizes = P.level_sizes(P.fine_counts(history(spark, sf_dir)))
    return sizes.groupBy("level").agg(F.count("*").alias("pools"), F.sum("size").alias("members"), F.max("size").alias("largest"))


def _assigned(spark, sf_dir):
    rows = features(spark, sf_dir)
    sizes = P.level_sizes(P.fine_counts(rows.where("year(flight_date) <= 2000")))
    return P.assign_pools(rows.where("year(flight_date) = 2001"), sizes, 30)


@query("SELECT t.service_id, CAST(a.level AS INTEGER) AS level FROM targets t LEFT JOIN assigned a ON t.service_id = a.service_id", *SCHEDULE, POOLS_SQL)
def pool_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("service_id", "level")


LABELS_SQL = " ".join(f"WHEN a.level = {i} THEN '{P.level_label(i, f)}'" for i, f in enumerate(P.LEVELS))


@query(f"SELECT CASE {LABELS_SQL} ELSE 'unsupported' END AS level_label, count(*) AS services FROM targets t LEFT JOIN assigned a ON t.service_id = a.service_id GROUP BY 1", *SCHEDULE, POOLS_SQL)
def pool_coverage_report(spark, sf_dir):
    return P.coverage_report(_assigned(spark, sf_dir)).select("level_label", "services")


@query("SELECT service_id, row_number() OVER (PARTITION BY origin, destination, quarter ORDER BY service_id) - 1 AS ordinal FROM features WHERE year(flight_date) <= 2000", *SCHEDULE)
def pool_membership_ordinals(spark, sf_dir):
    return P.members(history(spark, sf_dir), ("quarter",)).select("service_id", F.col("ordinal").cast("long").alias("ordinal"))


HASH_SQL = """SELECT origin, destination, operating_carrier, quarter, weekday, bucket, count(*) AS size, sha256('["' || string_agg(service_id, '","' ORDER BY service_id) || '"]') AS sha256
    FROM features WHERE year(flight_date) <= 2000 GROUP BY ALL"""


@query(HASH_SQL.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6"), *SCHEDULE)
def pool_membership_hash(spark, sf_dir):
    return P.membership_hash(history(spark, sf_dir), P.FIELDS)


VERSION = "sha256-service-rejection-v1"


@query("""SELECT o_orderkey, CAST((list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 8 + 1 AS BIGINT), 8) AS UBIGINT))),
    lambda a, w: (a * 4294967296 + w) % 37)) AS BIGINT) AS ordinal FROM (SELECT o_orderkey, sha256('["sha256-service-rejection-v1",{"seed":' || o_orderkey || '},0]') AS h FROM orders)""")
def uniform_draw(spark, sf_dir):
    key = F.concat(F.lit('{"seed":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    return load(spark, sf_dir, "orders").select("o_orderkey", uniform_index(key, F.lit(37), VERSION).alias("ordinal"))


@query("SELECT service_id, record_id, sha256('exact_replay|' || service_id) AS pool_id FROM services WHERE year(flight_date) = 2001", EXCLUDED_SQL, SERVICES_SQL)
def replay_map(spark, sf_dir):
    return P.replay_map(services(spark, sf_dir).where("year(flight_date) = 2001"))


def _offers(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("category", C.outcome_category(F.col("cancelled"), F.col("diverted")))
    actual = F.when(~F.col("cancelled"), F.col("departure") + F.col("departure_delay"))
    return rows.select("service_id", "origin", "destination", "departure", (F.col("departure") + F.col("elapsed")).alias("arrival"), "category", actual.alias("actual_departure"), (actual + F.col("elapsed")).alias("actual_arrival"), "flight_date")


OFFERS_SQL = f"""offers AS (SELECT service_id, origin, destination, departure, departure + elapsed AS arrival, {CATEGORY_SQL} AS category,
    CASE WHEN NOT cancelled THEN departure + departure_delay END AS actual_departure, CASE WHEN NOT cancelled THEN departure + departure_delay + elapsed END AS actual_arrival, flight_date FROM features)"""


@query("""SELECT CASE WHEN category = 'cancelled' THEN CASE WHEN actual_departure IS NOT NULL THEN 'UNRESOLVED' ELSE 'CANCELLED' END WHEN category = 'unknown' THEN 'UNRESOLVED'
    WHEN actual_departure < departure THEN 'MISSED_BOARDING' WHEN category = 'ordinary' AND actual_departure IS NULL THEN 'UNRESOLVED' WHEN category = 'ordinary' THEN 'ARRIVED' ELSE 'DIVERTED' END AS status,
    count(*) AS n, CAST(sum(CASE WHEN category = 'cancelled' THEN departure + 60 WHEN category = 'unknown' THEN NULL WHEN actual_departure < departure THEN departure WHEN category = 'ordinary' THEN actual_arrival END) AS BIGINT) AS next_decisions
    FROM offers GROUP BY 1""", *SCHEDULE, OFFERS_SQL)  # fmt: skip
def transition_outcomes(spark, sf_dir):
    made = R.transition(F.col("category"), F.col("actual_departure"), F.col("actual_arrival"), F.col("departure"), F.col("departure"), F.col("departure") - 1440, F.col("departure") + 1440)
    return _offers(spark, sf_dir).select(made.alias("t")).groupBy("t.status").agg(F.count("*").alias("n"), F.sum("t.next_decision").alias("next_decisions"))


def _requests(offers: DataFrame) -> DataFrame:
    """A trip for each first service of a day and origin in 2001: start an hour before it, two hours of grace."""
    first = offers.where("year(flight_date) = 2001").groupBy("flight_date", "origin").agg(F.min(F.struct("departure", "service_id", "destination", "arrival")).alias("f"))
    return first.select(F.concat_ws("/", F.col("flight_date").cast("string"), F.col("origin").cast("string")).alias("episode_id"), F.col("origin").alias("airport"), F.col("f.destination").alias("goal"), (F.col("f.departure") - 60).alias("start"), (F.col("f.arrival") + 120).alias("deadline"))


@query("""SELECT episode_id, service_id FROM (SELECT r.episode_id, o.service_id, row_number() OVER (PARTITION BY r.episode_id ORDER BY CAST(o.destination <> r.goal AS INTEGER), o.arrival, o.departure, o.service_id) AS k
    FROM (SELECT CAST(flight_date AS VARCHAR) || '/' || origin AS episode_id, origin AS airport, destination AS goal, departure AS ready, departure + 1380 AS until
        FROM (SELECT *, row_number() OVER (PARTITION BY flight_date, origin ORDER BY departure, service_id) AS first FROM offers WHERE year(flight_date) = 2001) WHERE first = 1) r
    JOIN offers o ON o.origin = r.airport AND o.departure >= r.ready AND o.departure < r.until) WHERE k = 1""", *SCHEDULE, OFFERS_SQL)  # fmt: skip
def greedy_offer(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    asked = _requests(offers).withColumn("ready", F.col("start") + 60).withColumn("until", F.col("start") + 1440)
    found = R.departures(offers, asked).select("episode_id", "goal", "service_id", "destination", "departure", "arrival")
    return R.greedy(found).select("episode_id", "service_id")


def _rolled(spark, sf_dir):
    from .plans.tables import Tables

    tables = Tables(spark, "rollout")
    offers = tables.cut(_offers(spark, sf_dir))
    requests = tables.cut(_requests(offers))
    return requests, offers, *R.rollout(requests, offers, tables)


@query()
def rollout_scores(spark, sf_dir):
    """A test plays the same trips one by one in Python."""
    return _rolled(spark, sf_dir)[2].select("episode_id", "reason", "decisions", "cancellations", "diversions", "missed", "reward")


EPISODES_SQL = """episodes AS (SELECT DISTINCT CAST(flight_date AS VARCHAR) || '/' || origin AS episode_id, origin AS airport FROM offers WHERE year(flight_date) = 2001)"""


@query("SELECT episode_id FROM episodes WHERE airport % 2 = 1", *SCHEDULE, OFFERS_SQL, EPISODES_SQL)
def verify_rollout(spark, sf_dir):
    """Episodes whose stored steps do not verify: those in which the first step's status was changed here, and no other."""
    requests, offers, _, steps = _rolled(spark, sf_dir)
    changed = (F.col("step") == 0) & (F.col("from") % 2 == 1)
    tampered = steps.withColumn("status", F.when(changed, F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    return R.verify_steps(requests, offers, tampered).select("episode_id").distinct()


@query("SELECT year(o_orderdate) AS year, count(*) AS archives, CAST(sum(round(o_totalprice)) AS BIGINT) AS size FROM orders GROUP BY 1")
def download_totals(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("archives"), F.sum(F.round("o_totalprice").cast("long")).alias("size"))


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def listing_parse(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    return load(spark, sf_dir, "pages").select("page_id", links.alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""SELECT year, count(*) AS n, count_if(departure_delay IS NOT NULL) * 1000000 // count(*) AS resolved_ppm FROM flights GROUP BY year""")
def audit_rates(spark, sf_dir):
    known = F.floor(F.count_if(F.col("departure_delay").isNotNull()) * 1000000 / F.count("*")).cast("long")
    return flights(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), known.alias("resolved_ppm"))


@query("SELECT sha256('[' || keys || ']') AS header, count(*) AS n FROM (SELECT regexp_replace(lower(event_type), '[^a-z0-9]', '', 'g') AS keys FROM events) GROUP BY 1")
def header_schema_groups(spark, sf_dir):
    header = F.sha2(F.concat(F.lit("["), normalize_column(F.col("event_type")), F.lit("]")), 256)
    return load(spark, sf_dir, "events").groupBy(header.alias("header")).agg(F.count("*").alias("n"))


@query("SELECT origin AS airport, min(flight_date) AS first_observed, max(flight_date) AS last_observed, count(*) AS occurrences FROM (SELECT origin, flight_date FROM flights UNION ALL SELECT destination, flight_date FROM flights) GROUP BY 1")
def airport_observations(spark, sf_dir):
    seen = flights(spark, sf_dir).select("flight_date", F.explode(F.array("origin", "destination")).alias("airport"))
    return seen.groupBy("airport").agg(F.min("flight_date").alias("first_observed"), F.max("flight_date").alias("last_observed"), F.count("*").alias("occurrences"))


@query("SELECT category, record_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY record_id) AS k FROM (SELECT record_id, " + CATEGORY_SQL + " AS category FROM flights)) WHERE k <= 5")
def quality_samples(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = flights(spark, sf_dir).select("record_id", C.outcome_category(F.col("cancelled"), F.col("diverted")).alias("category"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy("record_id"))).where("k <= 5").select("category", "record_id")


@query("SELECT origin, median(elapsed) AS median, max(CASE WHEN k = p THEN elapsed END) AS p95 FROM (SELECT origin, elapsed, row_number() OVER (PARTITION BY origin ORDER BY elapsed) AS k, least(count(*) OVER (PARTITION BY origin), (count(*) OVER (PARTITION BY origin)) * 95 // 100 + 1) AS p FROM flights) GROUP BY origin")
def draw_percentiles(spark, sf_dir):
    counts = flights(spark, sf_dir).groupBy("origin", "elapsed").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("origin").orderBy("elapsed"))).withColumn("all", F.sum("n").over(W.partitionBy("origin")))
    at = F.least(F.col("all"), F.floor(F.col("all") * 95 / 100) + 1)
    return upto.groupBy("origin").agg(F.percentile("elapsed", F.lit(0.5), F.col("n")).alias("median"), F.min(F.when(F.col("upto") >= at, F.col("elapsed"))).alias("p95"))


@query("SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM range(2020, 2026) t(y), range(1, 13) u(m)")
def requested_months(spark, sf_dir):
    return spark.range(2020 * 12, 2026 * 12).select(F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))


@query("SELECT l_orderkey, list_filter([CASE WHEN NOT origin <> destination THEN 'same_airport' END, CASE WHEN NOT elapsed > 0 THEN 'no_duration' END, CASE WHEN cancelled AND departure_delay IS NOT NULL THEN 'cancelled_with_departure' END], lambda x: x IS NOT NULL) AS violations, record_id FROM flights")
def record_violations(spark, sf_dir):
    from .operators.constraints import violations

    rules = {"same_airport": F.col("origin") != F.col("destination"), "no_duration": F.col("elapsed") > 0, "cancelled_with_departure": ~(F.col("cancelled") & F.col("departure_delay").isNotNull())}
    return flights(spark, sf_dir).select("l_orderkey", violations(rules).alias("violations"), "record_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import plan_queries, raw_queries  # noqa: E402, F401  register their queries with the decorator above

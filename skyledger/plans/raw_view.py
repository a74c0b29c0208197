"""Raw rows as an archive has them, all text, over the driver's tables; and airports with zones of fixed offsets.

The cells are SQL expressions that any engine reads alike. Some rows have cells that are no numbers, dates or flags, missing clocks,
contradicting arrivals, unknown airports and diversions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import SOURCE_COLUMNS
from .flight_view import flights

_DIVERTED = "CASE WHEN diverted THEN {} ELSE '' END"
CELLS = {
    "FlightDate": "CASE WHEN l_orderkey % 101 = 0 THEN '1/2/1998' ELSE CAST(flight_date AS STRING) END",
    "OriginAirportID": "CASE WHEN l_orderkey % 53 = 0 THEN 'x' WHEN l_orderkey % 59 = 0 THEN '-5' ELSE CAST(origin AS STRING) || '.00' END",
    "DestAirportID": "CAST(destination AS STRING)",
    "Origin": "' ap' || CAST(origin - 10000 AS STRING)", "Dest": "'AP' || CAST(destination - 10000 AS STRING)",
    "OriginStateName": "CASE WHEN l_partkey % 41 = 0 THEN 'Nowhere' ELSE 'State' END", "DestStateName": "''",
    "Marketing_Airline_Network": "marketing_carrier", "Operating_Airline": "operating_carrier",
    "Flight_Number_Marketing_Airline": "marketing_number", "Flight_Number_Operating_Airline": "operating_number",
    "CRSDepTime": "CASE WHEN l_suppkey % 37 = 0 THEN '2400' WHEN l_suppkey % 43 = 0 THEN '' ELSE lpad(CAST(CAST(floor(departure_minute / 60) AS INT) * 100 + departure_minute % 60 AS STRING), 4, '0') END",
    "CRSElapsedTime": "CASE WHEN l_partkey % 61 = 0 THEN '0' ELSE CAST(elapsed AS STRING) END",
    "DepDelay": "CASE WHEN departure_delay IS NULL THEN '' ELSE CAST(departure_delay AS STRING) || '.0' END",
    "ArrDelay": "CASE WHEN l_linenumber = 3 OR departure_delay IS NULL THEN '' WHEN l_linenumber = 4 THEN CAST(departure_delay + 7 AS STRING) ELSE CAST(departure_delay AS STRING) END",
    "ActualElapsedTime": "CASE WHEN l_linenumber = 5 THEN '' ELSE CAST(elapsed AS STRING) END",
    "Cancelled": "CASE WHEN l_orderkey % 67 = 0 THEN '2' WHEN cancelled THEN '1.00' ELSE '0' END", "Diverted": "CASE WHEN diverted THEN '1' ELSE '0.00' END",
    "DivReachedDest": _DIVERTED.format("CASE l_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END"),
    "DivActualElapsedTime": _DIVERTED.format("CAST(elapsed + 120 AS STRING)"), "DivAirportLandings": "CASE WHEN diverted THEN CAST(1 + l_orderkey % 2 AS STRING) ELSE '0' END",
    "Div1Airport": _DIVERTED.format("'AP0'"), "Div1AirportID": _DIVERTED.format("'10000'"),
    "Div2Airport": "CASE WHEN diverted AND l_partkey % 2 = 0 THEN 'AP5' ELSE '' END", "Div2AirportID": "CASE WHEN diverted AND l_partkey % 2 = 0 THEN 'none' ELSE '' END",
}
REFERENCE = [
    ("iata", "AP0", "US", "Zero", "K000", "STATE", "UTC"), ("iata", "AP1", "US", "One", "K001", "State", "Pacific/Honolulu"), ("iata", "AP2", "US", "Two", "K002", "State", "America/Phoenix"),
    ("lid", "AP3", "US", "Three", "K003", "State", "UTC"), ("lid", "AP5", "CA", "Five", "C005", "State", "UTC"),
]
OVERRIDES = [(10004, "AP4", "UTC", "review 4", "1990-01-01", "1995-12-31")]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.expr(CELLS[c] if c in CELLS else "CAST(NULL AS STRING)").alias(c) for c in SOURCE_COLUMNS]
    source = [F.lit("rows.zip").alias("path"), F.lit("a" * 64).alias("sha256"), F.concat("record_id", F.lit(".csv")).alias("member"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ordinal")]
    return flights(spark, sf_dir).select(*source, *cells)


def reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE, "kind string, code string, country string, name string, icao string, state string, zone string")


def overrides(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(OVERRIDES, "airport_id long, code string, time_zone string, source string, valid_from string, valid_to string")
    return rows.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})


#: The typed values that the cells stand for, read off the rules above and not off the text.
PARSED_SQL = """parsed AS (SELECT *, CASE WHEN l_orderkey % 101 <> 0 THEN flight_date END AS day, CASE WHEN l_orderkey % 53 <> 0 AND l_orderkey % 59 <> 0 THEN origin END AS origin_id,
        CASE WHEN l_orderkey % 67 <> 0 THEN cancelled END AS c, CASE WHEN diverted AND l_orderkey % 3 <> 2 THEN l_orderkey % 3 = 0 END AS reached,
        CASE WHEN l_partkey % 61 <> 0 THEN elapsed END AS planned, l_suppkey % 37 <> 0 AND l_suppkey % 43 <> 0 AS has_clock, CAST(1 + diverted AND l_partkey % 2 = 0 AS INTEGER) AS unused FROM flights),
    placed AS (SELECT *, CASE WHEN c IS NULL OR (c AND diverted) THEN 'unknown' WHEN c THEN 'cancelled' WHEN NOT diverted THEN 'ordinary' WHEN reached THEN 'diverted_reached' WHEN NOT reached THEN 'diverted_stranded' ELSE 'diverted_unknown' END AS category,
        CASE WHEN origin = 10004 THEN CASE WHEN origin_id = 10004 AND day <= DATE '1995-12-31' THEN 'resolved' ELSE 'unmapped' END WHEN l_partkey % 41 = 0 THEN 'conflict' ELSE 'resolved' END AS origin_status,
        CASE WHEN destination = 10005 THEN 'unmapped' WHEN destination = 10004 THEN CASE WHEN day <= DATE '1995-12-31' THEN 'resolved' ELSE 'unmapped' END ELSE 'resolved' END AS destination_status,
        CASE origin WHEN 10001 THEN 600 WHEN 10002 THEN 420 ELSE 0 END AS west FROM parsed),
    timed AS (SELECT *, CASE WHEN day IS NOT NULL AND origin_status = 'resolved' AND has_clock THEN date_diff('day', DATE '1970-01-01', day) * 1440 + departure_minute + west END AS sd FROM placed),
    flown AS (SELECT *, sd + planned AS sa, sd + departure_delay AS ad, CASE WHEN category = 'ordinary' AND l_linenumber <> 5 THEN sd + departure_delay + elapsed WHEN category = 'diverted_reached' THEN sd + departure_delay + elapsed + 120 END AS by_elapsed,
        CASE WHEN category = 'ordinary' AND l_linenumber <> 3 THEN sd + planned + departure_delay + CASE WHEN l_linenumber = 4 THEN 7 ELSE 0 END END AS by_delay FROM timed)""".replace(
    ", CAST(1 + diverted AND l_partkey % 2 = 0 AS INTEGER) AS unused", ""
)

"""Snapshots: flights, stops and airports as partitioned Parquet under the digest of what made them, with a manifest that is verified on opening."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import split_of
from ..operators.normalize import stop_rows

MANIFEST = "manifest.json"


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def strict_json(text: str):
    """What text holds; keys that repeat and constants that are no JSON are errors."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key repeats")
        return dict(pairs)

    def refused(x):
        raise ValueError(f"{x} is no JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=refused)


class Folder:
    """Small files and renames on the file system of a path, whichever Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(self.inside(name)))

    def inside(self, name: str) -> str:
        """A path under this folder; names that lead out of it are refused."""
        if name.startswith("/") or ":" in name or ".." in name.split("/"):
            raise ValueError(f"{name} leads out of the folder")
        return f"{self.path}/{name}"

    def write_json(self, name: str, value) -> None:
        """Creates a file; an existing one is an error."""
        out = self.fs.create(self.at(self.inside(name)), False)
        try:
            out.write(bytearray((canonical(value) + "\n").encode()))
        finally:
            out.close()

    def read_json(self, name: str):
        return strict_json("\n".join(r["value"] for r in self.spark.read.text(self.inside(name), wholetext=True).collect()))

    def rename(self, name: str, to: str) -> bool:
        return self.fs.rename(self.at(self.inside(name)), self.at(self.inside(to)))

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(self.inside(name)), True)


def content(df: DataFrame) -> dict:
    """Rows and an order-free checksum of all values: what a table's manifest entry holds."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(i), text).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (0, 1)]
    rows, a, b = df.agg(F.count("*"), *sums).first()
    return {"rows": rows, "checksum": [a, b], "schema": sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)}


def inventories(periods: Sequence[tuple[int, int]], historical: Sequence[int], evaluation: Sequence[int]) -> dict[str, list[str]]:
    """Months by split. Years are in one split at most, and from 2018 on."""
    if set(historical) & set(evaluation) or any(y < 2018 for y in (*historical, *evaluation)):
        raise ValueError("splits share no year and begin in 2018")
    named = {"historical": historical, "evaluation": evaluation}
    out = {"all": sorted(f"{y}-{m:02d}" for y, m in periods)}
    out |= {k: sorted(f"{y}-{m:02d}" for y, m in periods if y in years) for k, years in named.items()}
    return out | {"unassigned": sorted(f"{y}-{m:02d}" for y, m in periods if y not in (*historical, *evaluation))}


def publish(flights: DataFrame, airports: DataFrame, root: str, identity: Mapping, historical: Sequence[int], evaluation: Sequence[int]) -> str:
    """The path of a snapshot of normalized flights; one that is there for the same identity is verified and used again.

    Tables are written beside their place and moved there whole, so that no reader sees half of one.
    """
    spark = flights.sparkSession
    folder, name = Folder(spark, root), digest({"identity": dict(identity), "historical": sorted(historical), "evaluation": sorted(evaluation)})
    if folder.exists(name):
        verify(spark, f"{folder.path}/{name}")
        return f"{folder.path}/{name}"
    stage = f".pending-{uuid.uuid4().hex}"
    dated = flights.withColumns({"year": F.year("flight_date"), "month": F.month("flight_date")})
    dated.write.partitionBy("year", "month").option("compression", "zstd").parquet(folder.inside(f"{stage}/flights"))
    stop_rows(flights).write.option("compression", "zstd").parquet(folder.inside(f"{stage}/stops"))
    airports.write.option("compression", "zstd").parquet(folder.inside(f"{stage}/airports"))
    tables = {t: content(spark.read.parquet(folder.inside(f"{stage}/{t}"))) for t in ("flights", "stops", "airports")}
    written = spark.read.parquet(folder.inside(f"{stage}/flights"))
    periods = [(r["year"], r["month"]) for r in written.where("year is not null").select("year", "month").distinct().collect()]
    totals = written.agg(F.count("*").alias("rows"), F.count_if("cancelled").alias("cancelled"), F.count_if("diverted").alias("diverted")).first().asDict()
    folder.write_json(f"{stage}/{MANIFEST}", {"identity": dict(identity), "tables": tables, "totals": totals, "inventories": inventories(periods, historical, evaluation)})
    if not folder.rename(stage, name):  # another writer was first
        folder.drop(stage)
        verify(spark, f"{folder.path}/{name}")
    return f"{folder.path}/{name}"


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest of a snapshot whose tables have the rows, values and schemas that it says; else an error."""
    manifest = Folder(spark, path).read_json(MANIFEST)
    for table, said in manifest["tables"].items():
        if content(spark.read.parquet(f"{path}/{table}")) != said:
            raise ValueError(f"{table} is not what the manifest says")
    return manifest


class Store:
    """A verified snapshot to read from: flights with their stops, by split, inventory or record."""

    def __init__(self, spark: SparkSession, path: str, bound_to: str | None = None):
        if bound_to is not None and path.rstrip("/").rpartition("/")[2] != bound_to:
            raise ValueError("the artifact was made of another snapshot")
        self.spark, self.path, self.manifest = spark, path, verify(spark, path)
        self.flights = spark.read.parquet(f"{path}/flights")
        self.stops, self.airports = spark.read.parquet(f"{path}/stops"), spark.read.parquet(f"{path}/airports")

    def of(self, inventory: str) -> DataFrame:
        """Flights of an inventory's months: partitions are pruned by them."""
        months = [tuple(map(int, m.split("-"))) for m in self.manifest["inventories"][inventory]]
        return self.flights.where(F.array_contains(F.lit([y * 100 + m for y, m in months]), F.col("year") * 100 + F.col("month")) if months else F.lit(False))

    def source_refs(self, inventory: str = "all") -> DataFrame:
        """(sha256, member, ordinal) of an inventory in the order of months and records."""
        return self.of(inventory).orderBy("year", "month", "sha256", "ordinal").select("sha256", "member", "ordinal")

    def with_stops(self, flights: DataFrame) -> DataFrame:
        """flights with table_stops: their rows of the table of stops, in order; the array is empty without any."""
        rows = self.stops.groupBy("source_record_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "airport_id", "airport"))).alias("table_stops"))
        joined = flights.join(rows, "source_record_id", "left")
        return joined.withColumn("table_stops", F.coalesce("table_stops", F.array().cast(rows.schema["table_stops"].dataType)))

    def get(self, sha256: str, ordinal: int, allowed: Sequence[str] = ("all",)):
        """One flight with its stops, if its month is in an allowed inventory; PermissionError if not, KeyError if there is none."""
        found = self.with_stops(self.flights.where((F.col("sha256") == sha256) & (F.col("ordinal") == ordinal))).limit(2).collect()
        if len(found) != 1:
            raise KeyError((sha256, ordinal))
        row = found[0]
        if f"{row['year']}-{row['month']:02d}" not in {m for a in allowed for m in self.manifest["inventories"][a]}:
            raise PermissionError("the record is in no allowed inventory")
        if [s["stop_index"] for s in row["table_stops"]] != [s["stop_index"] for s in row["stops"]]:
            raise ValueError("the flight's stops are not those of the table")
        return row

    def split(self, historical: Sequence[int], evaluation: Sequence[int]) -> DataFrame:
        return self.flights.withColumn("split", split_of(F.col("year"), historical, evaluation))

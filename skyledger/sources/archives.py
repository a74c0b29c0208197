"""Source archives: one CSV member in a ZIP, read strictly, with record ordinals; validation and directory listings."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that an archive must have.
REQUIRED = (
    "Year Month FlightDate Origin Dest OriginAirportID DestAirportID Marketing_Airline_Network Operating_Airline CRSDepTime CRSArrTime CRSElapsedTime "
    "DepDelay ArrDelay ActualElapsedTime Cancelled Diverted DivReachedDest DivActualElapsedTime DivArrDelay DivAirportLandings "
    "Flight_Number_Marketing_Airline Flight_Number_Operating_Airline DepTime ArrTime CancellationCode"
).split() + [f"Div{i}{f}" for i in range(1, 6) for f in ("Airport", "AirportID", "WheelsOn", "WheelsOff")]


def folded(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


class Archive:
    """One archive's bytes: its CSV member, headers and records; ValueError for whatever is not as it must be."""

    def __init__(self, content: bytes):
        self.sha256 = hashlib.sha256(content).hexdigest()
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        found = [m for m in self.zip.infolist() if not m.is_dir() and m.filename.lower().endswith(".csv")]
        if len(found) != 1:
            raise ValueError("an archive has exactly one CSV member")
        self.member = found[0].filename

    def lines(self) -> Iterator[list[str]]:
        with self.zip.open(self.member) as raw, io.TextIOWrapper(raw, "utf-8-sig", newline="") as text:
            yield from csv.reader(text, strict=True)

    def records(self) -> Iterator[tuple[int, dict[str, str]]]:
        """(ordinal from 1, cells by trimmed header); a record of several lines counts once."""
        lines = self.lines()
        names = [h.strip() for h in next(lines, [])]
        used = [n for n in names if n]
        if not used or len(used) > len(set(used)):
            raise ValueError("headers are missing or repeat")
        for ordinal, cells in enumerate(lines, 1):
            if len(cells) != len(names):
                raise ValueError(f"record {ordinal}: {len(cells)} cells, {len(names)} headers")
            row = {}
            for name, cell in zip(names, cells):
                if name:
                    row[name] = cell
                elif cell.strip():
                    raise ValueError(f"record {ordinal}: a cell without a header is not empty")
            yield ordinal, row

    def validate(self, year: int, month: int) -> dict:
        """Counts and dates of a month's archive, all members read to their checksums."""
        lines = self.lines()
        headers = next(lines, [])
        named = [folded(h) for h in headers if h.strip()]
        if len(named) > len(set(named)):
            raise ValueError("columns repeat")
        if missing := sorted(c for c in REQUIRED if folded(c) not in named):
            raise ValueError("columns are missing: " + ", ".join(missing))
        at = {folded(h): i for i, h in enumerate(headers) if h.strip()}
        dates, rows, flagged = set(), 0, {"cancelled": 0, "diverted": 0}
        for rows, cells in enumerate(lines, 1):
            if len(cells) != len(headers):
                raise ValueError(f"record {rows}: {len(cells)} cells, {len(headers)} headers")
            day = date.fromisoformat(cells[at["flightdate"]])
            if cells[at["year"]] != str(year) or cells[at["month"]] not in (str(month), f"{month:02d}") or (day.year, day.month) != (year, month):
                raise ValueError(f"record {rows}: not of {year}-{month:02d}")
            for name in flagged:
                flag = float(cells[at[name]])
                if flag not in (0.0, 1.0):
                    raise ValueError(f"record {rows}: {name} is neither 0 nor 1")
                flagged[name] += int(flag)
            dates.add(day)
        if not rows:
            raise ValueError("no records")
        if broken := self.zip.testzip():
            raise ValueError(f"checksum of {broken}")
        return {"member": self.member, "columns": headers, "rows": rows, **flagged, "first": min(dates), "last": max(dates), "dates": sorted(dates)}


def read_archives(spark: SparkSession, paths: str | Sequence[str], rows: int = 4096) -> DataFrame:
    """(path, sha256, member, ordinal, cells): every record of every archive, cells a map by header. One task reads an archive as a whole, as ordinals need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                archive, held = Archive(bytes(content)), []
                for ordinal, cells in archive.records():
                    held.append((path, archive.sha256, archive.member, ordinal, cells))
                    if len(held) == rows:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    names = ["path", "sha256", "member", "ordinal", "cells"]
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, sha256 string, member string, ordinal long, cells map<string,string>")


def validate_archives(spark: SparkSession, months: DataFrame) -> DataFrame:
    """months (path, year, month) with what their archives hold; problem says why one is not valid (null: it is)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, year, month in zip(batch["path"], batch["content"], batch["year"], batch["month"]):
                found = dict.fromkeys(["member", "columns", "rows", "cancelled", "diverted", "first", "last", "dates", "problem"])
                try:
                    found |= Archive(bytes(content)).validate(int(year), int(month))
                except (ValueError, csv.Error, zipfile.BadZipFile) as e:
                    found["problem"] = str(e)
                out.append({"path": path, "year": year, "month": month, **found})
            yield pd.DataFrame(out, dtype=object)

    paths = [r["path"] for r in months.select("path").collect()]  # a row per month, not per record
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    asked = months.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "year", "month")
    joined = files.join(asked, F.regexp_replace("path", "^file:/+", "/") == F.col("p"))
    return joined.select("path", "content", "year", "month").mapInPandas(
        run, "path string, year int, month int, member string, columns array<string>, rows long, cancelled long, diverted long, first date, last date, dates array<date>, problem string"
    )


def requested_months(spark: SparkSession, start: int, end: int, month: int | None = None) -> DataFrame:
    """(year, month) from start to end, or the one month of each; years before 2018, reversed ranges and months outside 1 to 12 are refused."""
    if start < 2018 or end < start or (month is not None and not 1 <= month <= 12):
        raise ValueError("years from 2018, in order, and months from 1 to 12")
    every = spark.range(start * 12, (end + 1) * 12).select(F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    return every if month is None else every.where(F.col("month") == month)


def listing(html: Column, name: str = r"[^\"/<>]+\.zip") -> Column:
    """array(struct(name, size)) of the archives in a directory listing: a size, then a link. A listing without any is an error where it is used."""
    found = F.regexp_extract_all(html, F.lit(rf'([0-9]+)\s+<a\s+href="[^"]*/({name})"'), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'/([^/"]+)"$', 1).alias("name"), F.regexp_extract(x, "^([0-9]+)", 1).cast("long").alias("size")))


def download_states(requested: DataFrame, listed: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state) of requested (name): what is to do, by the listing (name, size), the manifest (name, size, sha256) and the files there (name, size, sha256).

    verified: file and manifest agree; adopted: a file of the listed size without an entry; conflict: a file that differs from its entry or the
    listing (never overwritten); download: no file; missing: not listed either.
    """
    rows = requested.select("name").join(listed.select("name", F.col("size").alias("listed")), "name", "left")
    rows = rows.join(manifest.select("name", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha")), "name", "left")
    rows = rows.join(present.select("name", F.col("size").alias("p_size"), F.col("sha256").alias("p_sha")), "name", "left")
    same = (F.col("p_size") == F.col("m_size")) & (F.col("p_sha") == F.col("m_sha"))
    state = (
        F.when(F.col("p_sha").isNotNull() & F.col("m_sha").isNotNull(), F.when(same, "verified").otherwise("conflict"))
        .when(F.col("p_sha").isNotNull(), F.when(F.col("p_size") == F.col("listed"), "adopted").otherwise("conflict"))
        .when(F.col("listed").isNull(), "missing")
        .otherwise("download")
    )
    return rows.select("name", state.alias("state"))


def missing_columns(headers: Column, required: Sequence[str] = REQUIRED) -> Column:
    """The required columns that a header row lacks, whatever its case and punctuation."""
    there = F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    wanted = F.array(*[F.struct(F.lit(folded(c)).alias("f"), F.lit(c).alias("c")) for c in required])
    return F.transform(F.filter(wanted, lambda w: ~F.array_contains(there, w["f"])), lambda w: w["c"])

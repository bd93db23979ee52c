"""Readers: JSON lines, JSON, CSV and spreadsheets into one typed candidate table; vectors, labels and rankings."""

from __future__ import annotations

import os
import warnings
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import narrative
from ..operators.semantic import valid_artifacts
from ..storage import free_name, row_numbers, written

ROLE = "struct<title:string,description:string,company:string,industry:string,start_date:string,end_date:string,duration_months:double,is_current:boolean>"
EDUCATION = "struct<tier:string,start_year:bigint,end_year:bigint>"
SKILL = "struct<name:string,proficiency:string,duration_months:double>"
SIGNALS = "struct<open_to_work_flag:boolean,notice_period_days:double,willing_to_relocate:boolean,recruiter_response_rate:double,avg_response_time_hours:double,last_active_date:string,github_activity_score:double,verified_email:boolean,verified_phone:boolean,linkedin_connected:boolean,skill_assessment_scores:map<string,double>>"
PROFILE = "struct<summary:string,headline:string,current_title:string,current_company:string,years_of_experience:double,location:string,country:string,current_industry:string>"
CANDIDATE = f"candidate_id string, profile {PROFILE}, career_history array<{ROLE}>, education array<{EDUCATION}>, skills array<{SKILL}>, signals {SIGNALS}"


def _typed(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _number(v: Column, path: str, numeric_text: bool = False) -> Column:
    """A number, or a boolean as 0 or 1. Text is none, but where numeric text is allowed."""
    text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    value = _typed(v, path, "double")
    return value if numeric_text else F.when(~F.coalesce(text, F.lit(False)), value)


def from_variants(rows: DataFrame, v: str = "v", signals_key: str = "signals") -> DataFrame:
    """Candidates of parsed objects. `signals_key` names the section of engagement signals in the source."""
    o = F.col(v)
    whole = lambda key, kind: _typed(o, f"$.{key}", kind)
    text = lambda x, key: _typed(x, f"$.{key}", "string")
    yes = lambda x, key: F.coalesce(_typed(x, f"$.{key}", "boolean"), F.lit(False))
    profile = F.struct(*[text(o, f"profile.{n}").alias(n) for n in ("summary", "headline", "current_title", "current_company")], _number(o, "$.profile.years_of_experience", True).alias("years_of_experience"), *[text(o, f"profile.{n}").alias(n) for n in ("location", "country", "current_industry")])
    items = lambda key: F.coalesce(whole(key, "array<variant>"), F.array().cast("array<variant>"))
    role = lambda r: F.struct(*[text(r, n).alias(n) for n in ("title", "description", "company", "industry", "start_date", "end_date")], _number(r, "$.duration_months").alias("duration_months"), yes(r, "is_current").alias("is_current"))
    school = lambda e: F.struct(text(e, "tier").alias("tier"), _typed(e, "$.start_year", "bigint").alias("start_year"), _typed(e, "$.end_year", "bigint").alias("end_year"))
    skill = lambda s: F.struct(text(s, "name").alias("name"), text(s, "proficiency").alias("proficiency"), _number(s, "$.duration_months").alias("duration_months"))
    at = signals_key
    signals = F.struct(
        yes(o, f"{at}.open_to_work_flag").alias("open_to_work_flag"), _number(o, f"$.{at}.notice_period_days").alias("notice_period_days"), yes(o, f"{at}.willing_to_relocate").alias("willing_to_relocate"),
        *[_number(o, f"$.{at}.{n}").alias(n) for n in ("recruiter_response_rate", "avg_response_time_hours")], text(o, f"{at}.last_active_date").alias("last_active_date"), _number(o, f"$.{at}.github_activity_score").alias("github_activity_score"),
        *[yes(o, f"{at}.{n}").alias(n) for n in ("verified_email", "verified_phone", "linkedin_connected")], whole(f"{at}.skill_assessment_scores", "map<string,double>").alias("skill_assessment_scores"),
    )
    keep = [c for c in rows.columns if c != v]
    return rows.select(*keep, text(o, "candidate_id").alias("candidate_id"), profile.alias("profile"), F.transform(items("career_history"), role).alias("career_history"), F.transform(items("education"), school).alias("education"), F.transform(items("skills"), skill).alias("skills"), signals.alias("signals"))


def _signals_key(rows: DataFrame) -> str:
    """The most frequent top-level key that is `signals` or ends with `_signals` (ties by name)."""
    found = rows.select(F.regexp_extract("value", r'"((?:[A-Za-z0-9]+_)?signals)"\s*:\s*\{', 1).alias("k")).where("k <> ''").groupBy("k").count().orderBy(F.desc("count"), "k").first()
    return found["k"] if found else "signals"


def read_json_lines(spark: SparkSession, path: str, signals_key: str | None = None) -> DataFrame:
    """Blank, unparseable and non-object lines are skipped; bad bytes become U+FFFD."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    key = signals_key or _signals_key(lines)
    parsed = lines.select(F.try_parse_json("value").alias("v"))
    return from_variants(parsed.where(F.schema_of_variant("v").startswith("OBJECT")), signals_key=key)


def read_json(spark: SparkSession, path: str, signals_key: str | None = None) -> DataFrame:
    """A file with one object or a list of them; anything else gives no rows."""
    text = spark.read.text(path, wholetext=True)
    key = signals_key or _signals_key(text)
    v = F.try_parse_json("value")
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = text.select(F.explode(listed).alias("v"))
    return from_variants(rows.where(F.schema_of_variant("v").startswith("OBJECT")), signals_key=key)


def numbered_rows(rows: DataFrame, name: str) -> DataFrame:
    """Adds `name`: the place of each row from 0, in the order in which the source is read."""
    order = free_name(rows, "order")
    # written, so that a row has the same number wherever it is read
    return row_numbers(written(rows.withColumn(order, F.monotonically_increasing_id()), "numbered"), [F.col(order)], name).drop(order)


def from_flat(rows: DataFrame, underscored: bool = True, prefix: str = "CAND_CSV_") -> DataFrame:
    """Candidates of flat text rows: columns bare, `profile.x` or (where underscored) `profile_x`, and likewise signals;
    JSON in the cells of the three lists, or skills by commas; a role is made up for an empty career."""
    columns = {c: F.col(f"`{c}`") for c in rows.columns}

    def cell(name: str, section: str) -> Column:
        ends = [name] + [c for c in columns if c.endswith(f"{section}.{name}") or (underscored and c.endswith(f"{section}_{name}"))]
        found = [F.nullif(columns[c], F.lit("")) for c in dict.fromkeys(ends) if c in columns]
        return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")

    years = F.coalesce(cell("years_of_experience", "profile").try_cast("double"), F.lit(0.0))
    texts = {n: F.coalesce(cell(n, "profile"), F.lit("")) for n in ("current_title", "current_company", "summary", "location", "country", "current_industry")}
    profile = F.struct(texts["summary"].alias("summary"), F.lit(None).cast("string").alias("headline"), texts["current_title"].alias("current_title"), texts["current_company"].alias("current_company"), years.alias("years_of_experience"), *[texts[n].alias(n) for n in ("location", "country", "current_industry")])
    listed = lambda name, kind: F.from_json(F.coalesce(columns.get(name, F.lit(None).cast("string")), F.lit("")), f"array<{kind}>")
    loose = F.filter(F.transform(F.split(F.coalesce(columns.get("skills", F.lit("")), F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    skills = F.coalesce(listed("skills", SKILL), F.transform(loose, lambda s: F.struct(s.alias("name"), F.lit("intermediate").alias("proficiency"), F.lit(12.0).alias("duration_months"))))
    months = F.when(years > 0, F.floor(years * 12)).otherwise(12).cast("double")
    none = F.lit(None).cast("string")
    made_up = F.array(F.struct(F.coalesce(F.nullif(texts["current_title"], F.lit("")), F.lit("Software Engineer")).alias("title"), none.alias("description"), F.coalesce(F.nullif(texts["current_company"], F.lit("")), F.lit("Company")).alias("company"), none.alias("industry"), none.alias("start_date"), none.alias("end_date"), months.alias("duration_months"), F.lit(True).alias("is_current")))
    career = F.coalesce(listed("career_history", ROLE), F.array().cast(f"array<{ROLE}>"))
    flag = lambda n: F.coalesce(F.lower(cell(n, "signals")).isin("true", "1"), F.lit(False))
    value = lambda n: cell(n, "signals").try_cast("double")
    no, nothing = F.lit(False), F.lit(None)
    signals = F.struct(
        flag("open_to_work_flag").alias("open_to_work_flag"), value("notice_period_days").alias("notice_period_days"), flag("willing_to_relocate").alias("willing_to_relocate"), F.coalesce(value("recruiter_response_rate"), F.lit(0.0)).alias("recruiter_response_rate"), nothing.cast("double").alias("avg_response_time_hours"),
        cell("last_active_date", "signals").alias("last_active_date"), value("github_activity_score").alias("github_activity_score"), no.alias("verified_email"), no.alias("verified_phone"), no.alias("linkedin_connected"), nothing.cast("map<string,double>").alias("skill_assessment_scores"),
    )
    own = [F.nullif(columns[c], F.lit("")) for c in ("candidate_id", "id") if c in columns]
    identity = F.coalesce(*own, F.lit(None).cast("string"))
    if not own or not rows.where(identity.isNull()).isEmpty():
        place = free_name(rows, "place")
        rows = numbered_rows(rows, place)
        identity = F.coalesce(identity, F.format_string(prefix + "%07d", F.col(place)))
    return rows.select(identity.alias("candidate_id"), profile.alias("profile"), F.when(F.size(career) > 0, career).otherwise(made_up).alias("career_history"), F.coalesce(listed("education", EDUCATION), F.array().cast(f"array<{EDUCATION}>")).alias("education"), skills.alias("skills"), signals.alias("signals"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return from_flat(spark.read.csv(path, header=True, multiLine=True, escape='"'))


_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _active_sheet(z: zipfile.ZipFile, ns: dict) -> str:
    """The file of the sheet that is shown when the workbook is opened; without a workbook part the first by name."""
    names = z.namelist()
    sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        return sheets[0]
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    view = book.find("m:bookViews/m:workbookView", ns)
    listed = book.findall("m:sheets/m:sheet", ns)
    active = int(view.get("activeTab", "0")) if view is not None else 0
    if active >= len(listed):
        return sheets[0]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    target = targets.get(listed[active].get(f"{_OFFICE}id"), "").lstrip("/")
    target = target if target.startswith("xl/") else f"xl/{target}"
    return target if target in names else sheets[0]


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _place(reference: str) -> int:
    """The column of a cell's reference, from 0; -1 without letters."""
    place = 0
    for x in reference:
        if x.isalpha():
            place = place * 26 + ord(x.upper()) - 64
    return place - 1


def stream_sheet(z: zipfile.ZipFile, first: int = 0, last: int | None = None):
    """Rows (from `first` to before `last`, of those there are) of a workbook's active sheet as lists of texts. The sheet is
    parsed as a stream: a row at a time is in memory, besides the table of shared texts."""
    shared: list[str] = []
    tag = lambda name: f"{{{_NS['m']}}}{name}"
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, item in ElementTree.iterparse(f):
                if item.tag == tag("si"):
                    shared.append("".join(t.text or "" for t in item.iter(tag("t"))))
                    item.clear()
    with z.open(_active_sheet(z, _NS)) as f:
        number = 0
        for _, row in ElementTree.iterparse(f):
            if row.tag != tag("row"):
                continue
            if last is not None and number >= last:
                return
            if number >= first:
                cells: dict[int, str] = {}
                for i, c in enumerate(row.findall("m:c", _NS)):
                    place, value = _place(c.get("r", "")), c.find("m:v", _NS)
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(tag("t")))
                    cells[i if place < 0 else place] = shared[int(text)] if c.get("t") == "s" else (text or "")
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            number += 1
            row.clear()


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's active sheet as text."""
    import io

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return list(stream_sheet(z))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet; columns bare or dotted. The file goes to one worker, which parses it."""
    from ..shipping import ship

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(frames):
        import pandas as pd

        for f in frames:
            for data in f["content"]:
                rows = sheet_rows(data)
                head = rows[0] if rows else []
                yield pd.DataFrame({"cells": [dict(zip(head, r)) for r in rows[1:] if any(r)]})

    cells = written(files.mapInPandas(parse, "cells map<string,string>"), "sheet")
    names = sorted({k for r in cells.select(F.map_keys("cells").alias("k")).distinct().collect() for k in r["k"]})
    return from_flat(cells.select(*[F.col("cells")[n].alias(n) for n in names]), underscored=False, prefix="CAND_XLSX_")


def read_candidates(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """By extension: .jsonl, .json, .csv, .xlsx or a Parquet table of candidates; limit 0 reads all."""
    readers = {".jsonl": read_json_lines, ".json": read_json, ".csv": read_csv, ".xlsx": read_xlsx}
    reader = readers.get(os.path.splitext(path)[1].lower(), lambda s, p: s.read.parquet(p))
    rows = reader(spark, path)
    return rows.limit(limit) if limit else rows


def narratives(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """candidate_id and narrative of each record; a record without id is ROW_n by its place from 0. limit 0 reads all.
    What an encoder takes in: batches of it are partitions' Arrow batches."""
    rows = numbered_rows(read_candidates(spark, path).select("candidate_id", narrative().alias("narrative")), "place")
    rows = rows.where(F.col("place") < limit) if limit else rows
    return rows.select(F.coalesce(F.nullif("candidate_id", F.lit("")), F.concat(F.lit("ROW_"), "place")).alias("candidate_id"), "narrative")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """candidate_id and tier; rows without either are skipped."""
    return spark.read.schema("candidate_id string, tier int").json(path).where("candidate_id is not null and tier is not null")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("candidate_id string, rank int, score string, reasoning string").csv(path, header=True, escape='"')


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("candidate_id string, row_idx bigint, embedding array<float>").parquet(path)


def read_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame | None, np.ndarray | None]:
    """(vectors, probes) of a folder that `write_artifacts` filled, or (None, None) with a warning where a part is missing or they do
    not belong together; a ranking then goes by texts alone."""
    try:
        vectors, ids = read_vectors(spark, f"{folder}/vectors"), spark.read.schema("candidate_id string").parquet(f"{folder}/ids")
        rows = spark.read.schema("place int, embedding array<float>").parquet(f"{folder}/probes").orderBy("place").collect()
    except AnalysisException:
        warnings.warn(f"{folder} lacks a part; texts alone decide", stacklevel=2)
        return None, None
    widths = {len(r["embedding"]) for r in rows}
    probes = np.array([r["embedding"] for r in rows], np.float32) if len(widths) == 1 else None
    if not valid_artifacts(vectors, ids, probes):
        warnings.warn(f"vectors, ids and probes in {folder} do not belong together; texts alone decide", stacklevel=2)
        return None, None
    return vectors, probes

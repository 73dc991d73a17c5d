"""Schema, policy and glossary files, transcripts by line, the template registry and the audit log."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T

MAX_SECTIONS = 1000
ADMINS = ("Admin", "Manager")
AUDIT = "action string, template_id string, version int, user string, role string, timestamp string"


def read_text(spark: SparkSession, path: str) -> str:
    """A small settings file, by Spark's own readers, so that it may lie in any store."""
    return spark.read.text(path, wholetext=True).first()[0]


def parse_sections(document: str) -> list[config.Section]:
    """Sections of a schema document. Of keys that repeat within an object the last counts."""
    found = json.loads(document)
    rows = found["sections"] if isinstance(found, dict) else found
    if len(rows) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections")
    return [config.Section(i, r["id"], r.get("title", r["id"]), bool(r.get("required", False)), r.get("description", ""), tuple(r.get("hints") or ()), tuple(r.get("keywords") or ()), tuple(r.get("fields") or ())) for i, r in enumerate(rows)]


def read_sections(spark: SparkSession, path: str) -> list[config.Section]:
    return parse_sections(read_text(spark, path))


def sections_from(rows: DataFrame) -> list[config.Section]:
    """Sections from a table (section_ord, section_id, title, required, description, hints): a schema, so few rows."""
    found = rows.orderBy("section_ord").limit(MAX_SECTIONS + 1).collect()
    if len(found) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections")
    return [config.Section(r["section_ord"], r["section_id"], r["title"], bool(r["required"]), r["description"] or "", tuple(r["hints"] or ())) for r in found]


def field_rows(sections: Sequence[config.Section]) -> list[tuple]:
    """(section_id, field_path, depth, label, type, options, columns) of all fields, nested ones too."""
    out = []

    def walk(section_id: str, fields: Sequence[dict], path: str, depth: int) -> None:
        for f in fields:
            at = f"{path}/{f.get('id', '')}"
            out.append((section_id, at, depth, f.get("label"), f.get("type"), [str(o) for o in f.get("options") or []], list(f.get("columns") or [])))
            walk(section_id, f.get("fields") or (), at, depth + 1)

    for s in sections:
        walk(s.section_id, s.fields, "", 0)
    return out


def fields_table(spark: SparkSession, sections: Sequence[config.Section]) -> DataFrame:
    return spark.createDataFrame(field_rows(sections), "section_id string, field_path string, depth int, label string, type string, options array<string>, columns array<string>")


def load_policy(spark: SparkSession, path: str) -> config.Policy:
    """The file's policy, the default for keys that it lacks or if it can't be read."""
    try:
        found = json.loads(read_text(spark, path))
    except Exception:  # noqa: BLE001 - a missing or broken file means the default
        return config.Policy()
    base = asdict(config.Policy())
    return config.Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in {**base, **{k: found[k] for k in base if k in found}}.items()})


def load_glossary(spark: SparkSession, path: str) -> config.Glossary:
    try:
        found = json.loads(read_text(spark, path))
    except Exception:  # noqa: BLE001
        return config.Glossary()
    base = config.Glossary()
    return config.Glossary(tuple(found.get("terms", base.terms)), tuple(found.get("phrase_corrections", dict(base.phrase_corrections)).items()), tuple(found.get("acronyms", dict(base.acronyms)).items()))


def save_settings(spark: SparkSession, settings: config.Policy | config.Glossary, path: str) -> None:
    """Overwrite a settings file."""
    d = asdict(settings)
    if isinstance(settings, config.Glossary):
        d = {k: dict(v) if k != "terms" else v for k, v in d.items()}
    spark.createDataFrame([(json.dumps(d),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def lines_of(transcripts: DataFrame, job_id: str = "job_id", text: str = "text") -> DataFrame:
    """job_id, line_id (number of the line in the text), text of lines that are not blank, stripped."""
    rows = transcripts.select(F.col(job_id).alias("job_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_id", "line"))
    return rows.select("job_id", "line_id", T.strip("line").alias("text")).filter("text <> ''")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments from JSON lines, Parquet or CSV, by the path's ending."""
    schema = "job_id string, seg_idx int, text string, start double, end double, avg_logprob double, speaker string"
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of recordings, for a transcriber to map over."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


# Templates


def create_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """New rows (template_id, version, title, schema, created_by) of requests whose role may write; versions count up."""
    last = versions.groupBy("template_id").agg(F.max("version").alias("last"))
    rows = requests.filter(F.col("role").isin(*ADMINS)).join(last, "template_id", "left")
    order = Window.partitionBy("template_id").orderBy("timestamp", "user")
    return rows.select("template_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int").alias("version"), "title", "schema", F.col("user").alias("created_by"))


def rejected(requests: DataFrame) -> DataFrame:
    return requests.filter(~F.coalesce(F.col("role").isin(*ADMINS), F.lit(False)))


def get_template(versions: DataFrame, template_id: str, version: int | None = None) -> DataFrame:
    rows = versions.filter(F.col("template_id") == template_id)
    return rows.filter(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version")).limit(1)


def list_templates(versions: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """template_id, title of the newest version, versions in order, locked."""
    rows = versions.groupBy("template_id").agg(F.max_by("title", "version").alias("title"), F.sort_array(F.collect_set("version")).alias("versions"))
    if locks is None:
        return rows.withColumn("locked", F.lit(False))
    last = locks.groupBy("template_id").agg(F.max_by(F.col("action") == "lock", "timestamp").alias("locked"))
    return rows.join(last, "template_id", "left").withColumn("locked", F.coalesce("locked", F.lit(False)))


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def audit_tail(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The last entries by time, oldest first; lines that can't be parsed are left out."""
    rows = spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("timestamp"), F.desc("template_id")).limit(limit).orderBy("timestamp", "template_id")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a line."""
    documents.select("document").write.mode("overwrite").text(path)


def write_markdown(markdown: DataFrame, path: str) -> None:
    """One folder a job."""
    markdown.select("job_id", "ordered_markdown").write.mode("overwrite").partitionBy("job_id").text(path)

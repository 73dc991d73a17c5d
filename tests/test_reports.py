"""Textual reports, filled forms, sources and sinks of files, and the audit stream."""

import json

import pytest
from pyspark.sql import functions as F

from relaynote import config
from relaynote.functions import text as T
from relaynote.operators import classify, coverage, placement, serving
from relaynote.plans import catalogue
from relaynote.sources import stores
from relaynote.streaming import folds


def test_quality_report_as_text(spark):
    names = "total_sentences assigned_sentences unclassified_sentences duplicate_count split_sentences"
    schema = "job_id long, " + ", ".join(f"{n} long" for n in names.split()) + ", avg_confidence double, min_confidence double, max_confidence double, coherence_score double"
    row = placement.metrics_report(spark.createDataFrame([(1, 9, 7, 2, 1, 3, 0.5, 0.25, 0.75, 1.0)], schema)).first()
    assert row["report"].split("\n") == ["Sentences: 9", "Assigned: 7", "Unclassified: 2", "Duplicates: 1", "Split: 3", "Confidence: 0.500 (0.250 to 0.750)", "Coherence: 1.000"]


def test_console_report_has_the_first_sentences_of_each_section(spark):
    sentences = [(i, f"Sentence {i} " + "x" * 120, 0.5) for i in range(7)]
    content = spark.createDataFrame([(1, "s1", "Deploy", 7, 0.5, 3, sentences), (1, "s0", "Alert", 1, 0.25, 0, sentences[:1])], "job_id long, section_id string, title string, sentence_count long, confidence double, appearance int, sentences array<struct<sent_idx:int,text:string,audio_confidence:double>>")
    overview = spark.createDataFrame([(1, 50.0, 0.3, ["s2", "s3"]), (2, 0.0, 1.0, [])], "job_id long, overall_coverage_percent double, overall_risk_score double, missing_required_sections array<string>")
    got = {r["job_id"]: r["report"].split("\n") for r in serving.console_report(content, overview).collect()}
    assert got[1][:5] == ["Job 1", "Coverage: 50.0%", "Risk: 0.30", "Missing: s2, s3", "Alert (1, 0.25)"]
    assert got[1][6] == "Deploy (7, 0.50)" and len(got[1]) == 12 and all(len(x) == 104 for x in got[1][7:])
    assert got[2] == ["Job 2", "Coverage: 0.0%", "Risk: 1.00", "Missing: ", ""]


def test_filled_form_is_one_document(spark):
    fields = spark.createDataFrame([("s0", "a", "boolean", None), ("s0", "b", "multi_select", ["Blue", "Red"]), ("s1", "c", "text", None)], "section_id string, field_id string, type string, options array<string>")
    content = spark.createDataFrame([("s0", ["a red one", "two"])], "section_id string, texts array<string>")
    d = json.loads(serving.filled_form(serving.form(content, fields), "handover").first()["document"])
    assert d["template_name"] == "handover" and [s["id"] for s in d["sections"]] == ["s0", "s1"]
    assert [json.loads(f["value"])["value"] for s in d["sections"] for f in s["fields"]] == [True, ["Red"], ""]


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_segments_are_read_by_the_ending(spark, tmp_path, kind):
    rows = [("j", 0, "hello, you", 0.0, 5.0, -0.5, "A"), ("j", 1, None, 5.0, None, None, None)]
    schema = "job_id string, seg_idx int, text string, start double, end double, avg_logprob double, speaker string"
    writer, path = spark.createDataFrame(rows, schema).coalesce(1).write, str(tmp_path / f"segments.{kind}")
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)
    assert sorted(map(tuple, stores.read_segments(spark, path).collect()), key=lambda r: r[1]) == rows


def test_documents_markdown_and_media_files(spark, tmp_path):
    stores.write_documents(spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}')], "job_id long, document string"), str(tmp_path / "d"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()) == ['{"a": 1}', '{"a": 2}']
    stores.write_markdown(spark.createDataFrame([(7, "# Report\n\n- a")], "job_id long, ordered_markdown string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).filter("job_id = 7").first()["value"].rstrip() == "# Report\n\n- a"
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.wav").write_bytes(b"\x00\x01")
    row = stores.read_media(spark, str(tmp_path / "media")).first()
    assert row["length"] == 2 and bytes(row["content"]) == b"\x00\x01"


def test_audit_entries_of_a_stream_are_appended(spark, tmp_path):
    entries = [("create", "t1", 1, "u", "Admin", f"2024-01-0{k}") for k in (1, 2, 3)]
    for e in entries:
        spark.createDataFrame([e], stores.AUDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start goes on where the first ended
        stream = spark.readStream.schema(stores.AUDIT).parquet(str(tmp_path / "in"))
        folds.audit_stream(stream, str(tmp_path / "log"), str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert [r["timestamp"] for r in stores.audit_tail(spark, str(tmp_path / "log"), 2).collect()] == ["2024-01-02", "2024-01-03"]
    assert stores.audit_tail(spark, str(tmp_path / "log")).count() == 3


def test_report_reads_the_analysis_once(spark):
    from relaynote.operators import coverage

    schema = "job_id long, section_id string, section_ord int, required boolean, status string, confidence double"
    rows = [(1, "b", 1, False, "partial", 0.5), (1, "a", 0, True, "covered", 0.25), (1, "c", 2, True, "missing", 0.0), (2, "b", 1, False, "covered", 0.5)]
    out = coverage.report(spark.createDataFrame(rows, schema), "t", "p", "m")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    (r,) = out.collect()  # a job without required sections has no report
    assert (r["job_id"], r["coverage_percentage"], r["confidence_score"], r["risk_score"]) == (1, 0.5, 0.125, 0.75)
    assert r["missing_required_sections"] == ["c"] and [(h["section_id"], h["heat"]) for h in r["heatmap"]] == [("a", 0.25), ("b", 0.25), ("c", 0.0)]


def test_sentence_report_scores_once_and_equals_the_report_of_coverage_and_classified(spark):
    secs = [config.Section(0, "s0", "Deploy steps", True, "deploy the service", ("deploy",)), config.Section(1, "s1", "Alerts", False, "alert rules", ("alert",))]
    rows = spark.createDataFrame([(1, 0, "Deploy the service now.", 0.5), (1, 1, "  ", 0.5), (1, 2, "An alert rule.", 0.5), (2, 0, "", 0.5), (None, 0, "Deploy.", 0.5)], "job_id long, sent_idx int, text string, audio_confidence double")
    jobs = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "job_id long")
    want = serving.quality_report(coverage.section_coverage(classify.classify(rows, secs), jobs, secs), classify.classify(rows, secs))
    scored = classify.scored(rows, secs).withColumn("text", F.when(T.strip("text") != "", "said").otherwise(""))
    got = serving.sentence_report(classify.ranked(classify.with_context(scored, secs), secs), jobs, secs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert serving.sentence_report(classify.ranked(classify.with_context(scored, secs), secs), jobs, []).count() == 0


def test_quality_report_reads_the_texts_once(spark):
    plan = catalogue.queries()["quality_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Generate posexplode" in line]) == 1

"""The whole document of a job: every key from a few sentences, folding, review logs, limits, jobs without sentences."""

import json

from pyspark.sql import functions as F

from relaynote.operators import document

PRIMARY = "struct<section_id:string,title:string,confidence:double>"
PLACED = f"job_id long, sent_idx int, text string, start double, end double, audio_confidence double, primary {PRIMARY}, destination string, to_idx int, evidence array<string>, reason string"
COVERAGE = "job_id long, section_id string, section_ord int, title string, required boolean, status string, sentence_count long, confidence double, risk_score double"
JOBS = "job_id long, parent_job_id long, timestamp string, transcript string"


def sentence(job, i, text, section=None, destination="placed", to=None, audio=0.5):
    primary = (section, section.upper(), 0.25) if section else None
    return (job, i, text, float(i), i + 1.0, audio, primary, destination, to, ["pod"] if "pod" in text else [], f"why {i}" if section else None)


def documents(spark, rows, coverage, jobs, feedback=None):
    feedback = feedback and spark.createDataFrame(feedback, "job_id long, note string")
    whole = document.document(spark.createDataFrame(rows, PLACED), spark.createDataFrame(coverage, COVERAGE), spark.createDataFrame(jobs, JOBS), feedback)
    return {r["job_id"]: json.loads(r["document"]) for r in document.as_json(whole).collect()}


def test_every_key_of_a_document(spark):
    rows = [
        sentence(1, 0, "The pod restarts.", "deploy", audio=0.2), sentence(1, 1, "Unsure  Thing", None, "review"), sentence(1, 2, "see https://grafana.example/d/1 now.", "monitoring", audio=0.4),
        sentence(1, 3, "unsure thing", "deploy", "review"), sentence(1, 4, "As noted earlier.", "deploy", "reference", 0), sentence(1, 5, "The POD  restarts.", "deploy", "duplicate", 0),
        sentence(1, 6, "Other", "deploy", "review"), sentence(1, 7, "More pods run.", "deploy", audio=0.3),
    ]
    coverage = [
        (1, "deploy", 0, "DEPLOY", True, "covered", 9, 0.3, 0.1), (1, "monitoring", 1, "MONITORING", True, "weak", 1, 0.4, 0.6), (1, "risks", 2, "RISKS", True, "missing", 0, 0.0, 1.0),
    ]
    d = documents(spark, rows, coverage, [(1, None, "now", "text")], [(1, "a"), (1, "a")])[1]
    assert (d["job_id"], d["parent_job_id"], d["timestamp"], d["transcript"]) == (1, None, "now", "text")
    assert round(d["overall_coverage_percent"], 6) == 66.666667 and round(d["overall_risk_score"], 6) == 0.566667 and d["missing_required_sections"] == ["risks"]
    assert [d[k] for k in ("section_count", "sentence_count", "unassigned_count", "asset_count", "explainability_logs_count", "human_feedback_count")] == [2, 8, 3, 1, 7, 2]
    assert d["coverage"]["deploy"] == {"section_title": "DEPLOY", "status": "covered", "required": True, "sentence_count": 2, "confidence": 0.3, "risk": 0.1}
    assert d["coverage"]["risks"]["sentence_count"] == 0  # without placed sentences the coverage's own count
    assert d["section_content"]["deploy"] == {"section_id": "deploy", "section_title": "DEPLOY", "sentence_count": 2, "confidence": 0.25, "sentences_preview": ["The pod restarts.", "More pods run."]}
    assert [s["section_id"] for s in d["ordered_section_content"]] == ["deploy", "monitoring"]
    assert [s["text"] for s in d["ordered_section_content"][0]["sentences"]] == ["The pod restarts.", "More pods run."]
    # alike texts once: the place of the first, the value of the last
    assert d["unassigned_sentences"] == [{"text": "unsure thing", "start": 3.0, "end": 4.0}, {"text": "Other", "start": 6.0, "end": 7.0}]
    # the k-th review is shown with the log of sentence k
    assert [r["text"] for r in d["review_required_sentences"]] == ["Unsure  Thing", "unsure thing", "Other"]
    assert [r["explainability"] and r["explainability"]["reasoning"] for r in d["review_required_sentences"]] == ["why 0", None, "why 2"]
    assert d["evidence"][0] == {"text": "The pod restarts.", "evidence": ["pod"]} and len(d["evidence"]) == 8
    assert d["assets"] == [{"type": "url", "content": "https://grafana.example/d/1", "component": d["assets"][0]["component"], "timestamp": 2.0}]
    assert [x["reasoning"] for x in d["top_explainability_logs"]] == ["why 0", "why 2", "why 3", "why 4", "why 5"]
    assert d["flow_coherence_score"] == 1.0 and d["flow_issues"] == [] and d["ordered_markdown"].startswith("# KT Report - 1\n\n## ")
    assert [(x["from_index"], x["note"], x["to_sentence"]) for x in d["cross_references"]] == [(4, "referential_link", "The pod restarts."), (5, "duplicate_reference", "The pod restarts.")]


def test_lists_are_cut_and_empty_jobs_are_there(spark):
    rows = [sentence(1, i, f"Line {i} pod https://a.example/{i} x.", "deploy" if i % 2 else None, "placed" if i % 2 else "review") for i in range(40)]
    rows.append(sentence(7, 0, "no job for this", "deploy"))
    d = documents(spark, rows, [], [(1, 0, None, None), (2, None, None, "")])
    assert set(d) == {1, 2}
    assert [len(d[1][k]) for k in ("unassigned_sentences", "evidence", "assets", "top_explainability_logs", "review_required_sentences")] == [5, 10, 10, 5, 20]
    assert d[1]["asset_count"] == 40 and len(d[1]["section_content"]["deploy"]["sentences_preview"]) == 3 and len(d[1]["ordered_section_content"][0]["sentences_preview"]) == 5
    assert d[2]["sentence_count"] == 0 and d[2]["coverage"] == {} and d[2]["flow_coherence_score"] == 1.0 and d[2]["overall_coverage_percent"] == 0.0
    assert d[2]["review_required_sentences"] == d[2]["cross_references"] == []


def test_no_jobs(spark):
    assert documents(spark, [], [], []) == {}
    assert document.unassigned(spark.createDataFrame([], PLACED)).filter(F.lit(True)).collect() == []

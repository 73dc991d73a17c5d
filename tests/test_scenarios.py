"""Scenarios end to end, settings and registries, and streams against batch."""

import json

import pytest
from pyspark.sql import functions as F

from relaynote import config
from relaynote.operators import assemble, chunks, classify, correct, coverage, placement, repair, segment, sessions
from relaynote.sources import stores
from relaynote.streaming import folds

SECTIONS = [
    config.Section(0, "architecture", "Architecture", True, "services components kafka streaming design", ("kafka", "service")),
    config.Section(1, "deployment", "Deployment", True, "deploy with kubernetes helm docker", ("kubectl", "helm")),
    config.Section(2, "troubleshooting", "Troubleshooting", False, "errors failures timeouts connection pool", ("timeout",)),
]
LOW = config.Policy(confidence_accept_threshold=0.05)


@pytest.fixture(scope="module")
def segments(spark):
    texts = [
        "The architecture has services and kafka streaming.", "We deploy with kubernetes and helm.",
        "It fails when the connection pool is exhausted and errors show.", "Run kubectl apply for the architecture services.",
        "We deploy with kubernetes and helm.", "Nothing matches here at all",
    ]
    rows = [("j", i, t, 5.0 * i, 5.0 * i + 5, -0.4 - 0.1 * i, "AB"[i % 2]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "job_id string, seg_idx int, text string, start double, end double, avg_logprob double, speaker string")


@pytest.fixture(scope="module")
def routed(segments):
    sentences = segment.align_segments(segment.ingest(segments))
    return classify.route(classify.classify(sentences, SECTIONS), LOW)


def test_sentences_have_places_and_times(segments):
    rows = segment.align_segments(segment.ingest(segments)).orderBy("sent_idx").collect()
    assert [r["sent_idx"] for r in rows] == list(range(len(rows)))
    assert rows[0]["start"] == 0.0 and rows[0]["end"] == 5.0 and rows[0]["speaker"] == "A"
    assert rows[1]["segment_ids"] == [1]


def test_every_sentence_has_one_destination(routed):
    placed = assemble.place(routed)
    assert placed.count() == routed.count()
    kinds = {r["destination"] for r in placed.collect()}
    assert kinds <= {"placed", "duplicate", "reference", "review", "duplicate_review", "empty", "dropped"}
    again = placed.filter("sent_idx = 4").first()
    assert again["destination"] == "duplicate" and again["to_idx"] == 1


def test_implementation_steps_do_not_go_to_conceptual_sections(routed):
    row = routed.filter("sent_idx = 3").first()
    assert row["primary"]["section_id"] != "architecture" or row["route"] == "review"


def test_causes_with_evidence_are_not_inferred(routed):
    row = routed.filter("sent_idx = 2").first()
    assert row["is_causal"] and "connection pool" in row["evidence"] and not row["is_inferred"]


def test_coverage_and_documents(routed):
    jobs = routed.select("job_id").distinct()
    cover = coverage.section_coverage(routed, jobs, SECTIONS)
    rows = {r["section_id"]: r for r in cover.collect()}
    assert set(rows) == {"architecture", "deployment", "troubleshooting"}
    assert all(0 <= r["risk_score"] <= 1 for r in rows.values())
    document = assemble.documents(repair.repair(assemble.place(routed)), cover, coverage.job_overview(cover)).first()["document"]
    found = json.loads(document)
    assert found["job_id"] == "j" and 0 <= found["overall_coverage_percent"] <= 100 and len(found["coverage"]) == 3


def test_classification_agrees_at_any_partitioning(segments, spark):
    def run(n):
        rows = classify.classify(segment.align_segments(segment.ingest(segments.repartition(n))), SECTIONS)
        return sorted((r["sent_idx"], r["primary"]["section_id"], round(r["primary"]["confidence"], 9)) for r in rows.collect())

    assert run(1) == run(7)


def test_repair_of_misheard_phrases(spark):
    rows = spark.createDataFrame([("j", 0, "we use coffee for a sink jobs", 0.1), ("j", 1, "rollback plan is open", 0.1)], "job_id string, sent_idx int, text string, audio_confidence double")
    got = {r["sent_idx"]: r["enhanced_text"] for r in repair.repair(rows).collect()}
    assert "Kafka" in got[0] and got[1] == "rollback plan is open"


def test_corrections_are_recorded(spark):
    rows = spark.createDataFrame([("j", 0, "cubernetes runs, katie knows", 0.0)], "job_id string, seg_idx int, text string, start double")
    row = correct.correct_segments(rows).first()
    assert row["text"].startswith("kubernetes") and {c["type"] for c in row["corrections"]} == {"phrase"} and len(row["corrections"]) == 2
    assert correct.correction_stats(correct.correct_segments(rows)).first()["total_corrections"] == 2


def test_fields_take_their_best_chunk(spark):
    sections = [config.Section(0, "dep", "Deployment", True, "", ("deploy",), (), ({"id": "rollback_steps", "label": "Rollback steps", "type": "text"},))]
    docs = spark.createDataFrame([(1, "deploy and rollback steps"), (2, "deploy only")], "doc_id long, text string")
    best = chunks.best_section(chunks.chunk_documents(docs), sections)
    rows = chunks.map_fields(best, sections).collect()
    assert [(r["job_id"], r["field_id"]) for r in rows] == [(1, "rollback_steps")]


def test_lines_are_split_where_sections_differ(spark):
    lines = spark.createDataFrame([("j", 0, "the architecture has services and kafka streaming components and deploy with kubernetes helm docker")], "job_id string, line_id int, text string")
    units = placement.place_lines(lines, SECTIONS, accept=0.05).collect()
    assert {u["unit_id"] for u in units} >= {"0_clause_0"} and all(u["is_split"] for u in units)


def test_later_corrections_win(spark):
    rows = spark.createDataFrame([("j", 0, "a", "review")], "job_id string, sent_idx int, section_id string, route string")
    fixes = spark.createDataFrame([("j", 0, "b", "u", 1), ("j", 0, "c", "u", 2)], "job_id string, sent_idx int, corrected_section string, user string, at long")
    row = sessions.apply_corrections(rows, fixes).first()
    assert (row["section_id"], row["route"], row["corrected"]) == ("c", "accepted", True)


def test_settings_come_back(spark, tmp_path):
    policy = config.Policy(confidence_accept_threshold=0.5)
    stores.save_settings(spark, policy, str(tmp_path / "policy"))
    assert stores.load_policy(spark, str(tmp_path / "policy")) == policy
    assert stores.load_policy(spark, str(tmp_path / "none")) == config.Policy()
    assert stores.load_glossary(spark, str(tmp_path / "none")) == config.Glossary()


def test_schema_documents(spark):
    sections = stores.parse_sections('{"sections": [{"id": "a", "title": "A", "hints": ["x"], "hints": ["y"], "fields": [{"id": "f", "fields": [{"id": "g"}]}]}]}')
    assert sections[0].hints == ("y",)
    assert [r["field_path"] for r in stores.fields_table(spark, sections).collect()] == ["/f", "/f/g"]


def test_template_versions_and_audit(spark, tmp_path):
    none = spark.createDataFrame([], "template_id string, version int, title string")
    asks = spark.createDataFrame([("t", "T", "{}", "u", "Admin", "1"), ("t", "T2", "{}", "u", "Manager", "2"), ("t", "T3", "{}", "u", "Guest", "3")], "template_id string, title string, schema string, user string, role string, timestamp string")
    made = stores.create_versions(asks, none)
    assert sorted(r["version"] for r in made.collect()) == [1, 2] and stores.rejected(asks).count() == 1
    assert stores.list_templates(made).first()["title"] == "T2" and stores.get_template(made, "t").first()["version"] == 2
    path = tmp_path / "audit"
    path.mkdir()
    (path / "a.json").write_text('{"action": "create", "timestamp": "1"}\nnot json\n{"action": "lock", "timestamp": "2"}\n')
    assert [r["action"] for r in stores.audit_tail(spark, str(path)).collect()] == ["create", "lock"]


def test_stream_of_documents_is_like_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, "kafka service streaming " * (1 + i)) for i in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.section_stream(stream, SECTIONS).writeStream.format("memory").queryName("sections").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["job_id"], r["section_id"]): r["chunk_count"] for r in spark.table("sections").collect()}
    batch = chunks.best_section(chunks.chunk_documents(rows), SECTIONS).filter("section_id is not null").groupBy("job_id", "section_id").agg(F.count("*").alias("n"))
    assert got == {(r["job_id"], r["section_id"]): r["n"] for r in batch.collect()}


def test_sentences_across_batches(spark, tmp_path):
    schema = "job_id string, seg_idx int, text string"
    for k, part in enumerate([[("j", 0, "One. Two is"), ("j", 1, "not done")], [("j", 2, "yet. Three!")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    query = folds.sentence_stream(stream).writeStream.format("memory").queryName("sents").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.processAllAvailable()
    query.stop()
    got = [r["text"] for r in spark.table("sents").orderBy("sent_idx").collect()]
    assert got == ["One.", "Two is not done yet.", "Three!"]

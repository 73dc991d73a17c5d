"""Text functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from relaynote import config
from relaynote.functions import scores as S
from relaynote.functions import text as T

TEXTS = [
    "One. Two!  Three? four", "", "   ", None, "No end", "Größe ist Größe. Öl läuft.", "tab\tand\nline. Next one.", "a.b c. D",
    "word " * 300, "x" * 1000, ", ".join(["part of it"] * 60) + ".", "first, " + "y" * 300 + ", last",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def values(rows, column):
    return [r[0] for r in rows.orderBy("i").select(column.alias("x")).collect()]


def packed(sentence, most=240):
    if len(sentence) <= most:
        return [sentence]
    parts = [p.strip() for p in sentence.split(",") if p.strip()]
    if len(parts) < 2:
        return [sentence[i : i + most] for i in range(0, len(sentence), most)]
    out = [parts[0]]
    for p in parts[1:]:
        if len(out[-1]) + len(p) + 2 <= most:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def test_sentences(rows):
    want = [None if t is None else [s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s] for t in TEXTS]
    assert values(rows, T.sentences("text")) == want


def test_tokens_and_words(rows):
    assert values(rows, T.tokens("text")) == [None if t is None else re.findall(r"\w+", t.lower()) for t in TEXTS]
    assert values(rows, T.words("text")) == [None if t is None else t.split() for t in TEXTS]


def test_long_sentences_are_packed(rows):
    known = rows.filter("text is not null and text <> ''")
    assert values(known, T.pack_long(F.col("text"))) == [packed(t) for t in TEXTS if t]


def test_word_chunks(rows):
    want = [[" ".join(t.split()[i : i + 120]) for i in range(0, len(t.split()), 120)] for t in TEXTS if t is not None]
    assert values(rows.filter("text is not null"), T.word_chunks("text")) == want


def test_clauses(spark):
    texts = ["short and sweet", "we start the service here now and then we wait for the logs", "one two three four five six; seven eight nine ten eleven", "one two three four five (six seven) eight nine ten eleven"]
    got = values(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), T.clauses(F.col("text")))
    assert got == [
        ["short and sweet"],
        ["we start the service here now", "then we wait for the logs"],
        ["one two three four five six", "seven eight nine ten eleven"],
        ["one two three four five", "six seven", "eight nine ten eleven"],
    ]


def warnings(text, names):
    toks, out = re.findall(r"\w+", text.lower()), []
    for i, t in enumerate(toks):
        for n in names:
            near = toks[max(0, i - 3) : i + 4]
            word = next((a for a in config.AMBIGUOUS_NEARBY if a in near), None)
            if n.lower() == t and word:
                out.append(f"Glossary term '{n}' appears near ambiguous word '{word}'")
    return list(dict.fromkeys(out))


def test_ambiguity_warnings(spark):
    texts = ["The API near a customer, and the api of a box", "kafka kafka client person", "REST alone", "", "service one two three bucket"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    glossary = config.Glossary()
    names = [*glossary.terms, *[a for a, _ in glossary.acronyms]]
    assert values(rows, T.ambiguity_warnings("text")) == [warnings(t, names) for t in texts]


def test_grammar_and_glossary(spark):
    rows = spark.createDataFrame([(0, " hello  there", 0.2), (1, "Done.", 0.9), (2, "we use coffee for a sink jobs", 0.1)], "i int, text string, conf double")
    assert values(rows, T.fix_grammar("text")) == ["Hello there.", "Done.", "We use coffee for a sink jobs."]
    assert values(rows, T.glossary_corrected("text", "conf"))[2] == "we use Kafka for async jobs"


def test_predicates(spark):
    texts = ["It fails because the connection pool is exhausted", "Run kubectl apply -f x.yaml", "As I mentioned before, restart", "Rollback plan is here", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert values(rows, T.is_causal("text")) == [True, False, False, False, False]
    assert values(rows, T.is_implementation("text"))[:2] == [False, True]
    assert values(rows, T.is_referential("text"))[2] is True
    assert values(rows, T.is_protected("text"))[3] is True
    assert values(rows, T.evidence("text"))[0] == ["connection pool"]


def test_urls_and_components(spark):
    rows = spark.createDataFrame([(0, "see https://grafana.example/d/1, and http://x.y/z")], "i int, text string")
    assert values(rows, T.urls("text")) == [["https://grafana.example/d/1,", "http://x.y/z"]]
    assert values(rows, T.component(F.lit("https://ci.example/Jenkins"))) == ["jenkins"]


def test_scores(spark):
    rows = spark.createDataFrame([(0, -0.4), (1, None), (2, -5.0), (3, 3.0)], "i int, x double")
    assert values(rows, S.audio_confidence("x")) == [0.8, 0.5, 0.0, 1.0]
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert values(rows, S.jaccard(a, b))[0] == pytest.approx(1 / 3)
    assert values(rows, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))))[0] == pytest.approx(1)

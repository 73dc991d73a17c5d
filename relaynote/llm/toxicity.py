"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, save

#: The model is fitted on this many labelled rows at most (on average: rows are picked by a hash threshold).
SAMPLE_ROWS = 20_000
#: What makes a feature of the model, not a bound on the data: entries of the lexicon, labelled toxic texts that must
#: hold one, and its least log odds.
LEXICON, LEAST_TEXTS, LEAST_ODDS = 3000, 4, 1.5
NEAR = 5
TREES, DEPTH = 20, 3

# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus".split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MASKED = re.compile(r"[^\W\d_][*@$#%&!+|0-9_.\-]+[^\W\d_]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Characters that stand for letters in masked words.
_STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "#": None, "%": None, "&": None, "+": None, "|": None})


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings of 4 to 6 letters."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) >= k)]


def unit_counts(sample: DataFrame) -> DataFrame:
    """unit, toxic texts and other texts with it, over the sample's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[toxic].update({u for w in set(_WORD.findall(text.lower())) for u in units(w)})
            names = list({*found[0], *found[1]})
            yield pa.record_batch({"unit": pa.array(names, pa.string()), "bad": pa.array([found[1][u] for u in names], pa.int64()), "good": pa.array([found[0][u] for u in names], pa.int64())})

    parts = sample.select("text", "toxic").mapInArrow(run, "unit string, bad long, good long")
    return parts.groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def feature_function(lexicon: dict[str, float]) -> Callable[[str], list[float]]:
    weights: dict[str, float] = {}

    def weight(word: str) -> float:
        got = weights.get(word)
        if got is None:
            if len(weights) > 300_000:
                weights.clear()
            got = weights[word] = max((lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        return got

    def features(text: str) -> list[float]:
        lower, data = text.lower(), text.encode()
        words = _WORD.findall(lower)
        n, chars = max(len(words), 1), max(len(data), 1)
        found = [weight(w) for w in words]
        at = [i for i, x in enumerate(found) if x]
        near = 0
        if at:
            persons = {i + d for i, w in enumerate(words) if w in SECOND_PERSON for d in range(-NEAR, NEAR + 1)}
            near = sum(i in persons for i in at)
        masked = _MASKED.findall(text)
        unmasked = sum(weight(w.translate(_STANDS_FOR)) > 0 for w in lower.split() if _MASKED.search(w)) if masked else 0
        return [
            math.log1p(len(words)),
            sum(found) / n,
            len(at) / n,
            math.log1p(len(at)),
            math.log1p(len({words[i] for i in at})),
            max(found, default=0.0),
            near / n,
            near / max(len(at), 1),
            (len(data) - len(data.translate(None, _CAPITALS))) / chars,
            (data.count(b"!") + data.count(b"?")) / chars,
            (data.count(b".") + data.count(b",")) / chars,
            len(masked) / n,
            unmasked / n,
        ]

    return features


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def features(self, text: str | Column) -> Column:
        lexicon = self.lexicon

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            give_back()
            of = feature_function(lexicon)
            for texts in batches:
                yield pd.Series([of(t) for t in texts])

        return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with `_score`: the calibrated probability; the trees' own one orders texts of one isotonic step."""
        if self.trees is None or self.calibration is None:
            return docs.withColumn("_score", F.lit(self.prior))
        return self.with_raw(docs).transform(self._calibrate)

    def with_raw(self, docs: DataFrame) -> DataFrame:
        out = self.trees.transform(docs.withColumn("_features", array_to_vector(self.features("text"))))
        return out.withColumn("_raw", vector_to_array("_probability")[1]).drop("_features", "_rawPrediction", "_probability", "_prediction")

    def _calibrate(self, docs: DataFrame) -> DataFrame:
        out = self.calibration.transform(docs)
        return out.withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_step") * 0.999 + F.col("_raw") * 0.001))).drop("_step", "_raw")


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def draw(text: str) -> Column:
    """What a text is drawn by. As a column of the documents it is there before they meet their labels, so texts that are
    not drawn are never shuffled, and none is for the count of different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(3))


def fit_toxicity(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> ToxicityModel:
    """Fit on labelled rows (doc_id, text, toxic), on a sample of sample_rows at most. Texts that repeat count once.

    Rows with a null label are left out. If either label is missing, every score is the share of label 1, 0 without rows.
    """
    drawn = labelled if "draw" in labelled.columns else labelled.withColumn("draw", draw("text"))
    known = drawn.filter("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"), "draw")
    # the draw is by text, so the share follows from the number of different texts, whatever the number of copies
    n = known.agg(F.approx_count_distinct("draw", 0.02)).first()[0]
    share = min(1.0, 0.9 * sample_rows / max(n, 1))  # an estimate and a draw by chance stay within the bound
    picked = known.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("key", F.unhex(F.sha2("text", 256)))
    # Equal texts are one row, toxic if any of them is, whatever the order in which rows come.
    held = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(4)) == 0
    sample = save(picked.groupBy("key").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("held", held).repartition(6, "key"), "sample")
    sizes = {(r["held"], r["toxic"]): r["n"] for r in sample.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = (sum(n for (_, toxic), n in sizes.items() if toxic == of) for of in (1, 0))
    if not bad or not good:
        return ToxicityModel({}, None, None, bad / max(bad + good, 1))
    # A quarter is held back from lexicon and trees for the calibration, unless a label would be missing on either side.
    apart = len(sizes) == 4
    learned = sample.filter("not held") if apart else sample
    bad, good = (sum(n for (of_held, toxic), n in sizes.items() if toxic == of and not (apart and of_held)) for of in (1, 0))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counts = unit_counts(learned).filter(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") > LEAST_ODDS)
    lexicon = {r["unit"]: r["odds"] for r in counts.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "unit").limit(LEXICON).collect()}
    model = ToxicityModel(lexicon, None, None, 0.0)
    table = save(sample.select((F.col("toxic") * 1.0).alias("_label"), model.features("text").alias("_array"), (F.col("held") & apart).alias("_held")), "features")
    table = table.withColumn("_features", array_to_vector("_array"))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=1)
    gbt.setRawPredictionCol("_rawPrediction").setProbabilityCol("_probability")
    model.trees = gbt.fit(table.filter("not _held"))
    fresh = model.trees.transform(table.filter(F.col("_held") | F.lit(not apart)).select("_label", "_features"))
    fresh = fresh.select("_label", vector_to_array("_probability")[1].alias("_raw"))
    model.calibration = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_step").fit(fresh)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """docs with held_out, score and predicted (columns of docs with these names give way).

    Labels are learned from rows whose crc32(doc_id as text) mod folds is not 0; the others are held out. A null
    doc_id counts as held out. Null texts are scored as empty ones. Repeated rows are scored each, alike; of texts with
    both labels the toxic one counts. Very long texts are read whole. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(True))
    known = docs.filter(~held).select("doc_id", "text", draw("text").alias("draw")).join(labels.select("doc_id", "toxic"), "doc_id")
    rows = docs.select(F.struct(*names).alias("row"), "text", held.alias("held_out"))  # no name can clash inside
    scored = fit_toxicity(known).score(rows)
    return scored.select("row.*", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))

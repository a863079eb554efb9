"""Toxicity scores (operator 7): gradient-boosted trees over dense features, isotonic calibration.

1. A bounded sample of labelled rows (``sample_rows``, the smallest hashes of the id) that are not held
   out is the only thing labels are learned from.
2. Lexicon: words and word beginnings whose share among the sample's toxic texts clearly exceeds that
   among the others (lower bound of the log odds), weighted by it; ``lexicon_size`` entries at most.
3. Dense features per text: lexicon densities, lexicon words near a second-person word, capitals,
   punctuation, obfuscation (look-alike characters, stretched letters), length.
4. Spark ML: a boosted-tree classifier on three quarters of the sample, isotonic regression of its
   probability on the rest.
Scoring is one Arrow pass for the features and the fitted models on top; no shuffle.

Null texts count as empty; every text, empty ones too, gets a score.  Null labels are ignored; several
labels of one id count as their largest.  If the sample holds one class only, every score is its share
of toxic rows (0 without rows).  Rows that repeat an id give a row each; empty tables give empty results;
other columns pass through ``keep_clean`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, col, fresh, held_out, slices, stored

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinem deinen deiner ihr euch euer "
                          "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros tuyo".split())
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_][\w@$!|'*-]*")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_ODD = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_PUNCT = re.compile(r"[^\w\s]")
HIT, YOU, ODD, DISGUISED, STRETCHED = 1, 2, 4, 8, 16
BEGINNINGS = (4, 5, 6)
NEAR = 3

FEATURES = ["weight_density", "hit_density", "hits", "kinds", "max_weight", "near_second_person", "second_person",
            "capitals", "all_caps", "exclamations", "punctuation", "odd_spellings", "disguised_hits", "stretched", "log_words"]


def terms(text: str) -> set[str]:
    """Words, and beginnings of longer words (marked by a trailing *), of a text.  A word of more than 24
    characters is no entry of its own; its beginnings are."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) <= 24} | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


class _Marks(dict):
    """Word -> what it shows (HIT, YOU, ODD, DISGUISED, STRETCHED), found once and kept up to a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 500_000):
        self.lexicon, self.most = lexicon, most

    def weight(self, word: str) -> float:
        """Largest weight of the word or of its beginnings; 0 if none is listed."""
        get = self.lexicon.get
        return max(get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in BEGINNINGS if len(word) > n), 0.0)

    def __missing__(self, word: str) -> int:
        hit = self.weight(word) > 0
        plain = word.isalpha()
        mark = (HIT * hit | YOU * (word in SECOND_PERSON) | ODD * (not plain and _ODD.search(word) is not None)
                | DISGUISED * (not hit and not plain and self.weight(word.translate(LOOKALIKES)) > 0)
                | STRETCHED * (_STRETCH.search(word) is not None))
        if len(self) >= self.most:
            self.clear()
        self[word] = mark
        return mark


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.marks = _Marks(lexicon)

    def of(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        marks = np.frombuffer(bytes(map(self.marks.__getitem__, words)), np.uint8)
        n, size = max(1, len(words)), max(1, len(text))
        hit, you = np.flatnonzero(marks & HIT), np.flatnonzero(marks & YOU)
        weights = [self.marks.weight(words[i]) for i in hit.tolist()]
        near = 0
        if len(hit) and len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(hit - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hit))
            near = int((gap <= NEAR).sum())
        count = lambda flag: int(np.count_nonzero(marks & flag))
        return [100 * sum(weights) / n, 100 * len(hit) / n, float(len(hit)), float(len({words[i] for i in hit.tolist()})),
                max(weights, default=0.0), 100 * near / n, 100 * len(you) / n, len(_UPPER.findall(text)) / size,
                100 * len(_CAPS.findall(text)) / n, 100 * text.count("!") / size, 100 * len(_PUNCT.findall(text)) / size,
                100 * count(ODD) / n, float(count(DISGUISED)), 100 * count(STRETCHED) / n, float(np.log1p(len(words)))]


def learn_lexicon(sample: DataFrame, size: int, least_odds: float = 3.0) -> dict[str, float]:
    """Entries of ``sample(text, y)`` with a clear excess among toxic texts."""
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)

    def run(batches):
        for part in slices(batches, 0):
            seen = (Counter(), Counter())
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[y].update(terms(text or ""))
            keys = list(seen[1])  # a term without a toxic text cannot enter
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                              pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "t", "c"])
            keys = [k for k in seen[0] if k not in seen[1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([0] * len(keys), pa.int64()),
                                              pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "t", "c"])

    counts = (sample.select("text", "y").mapInArrow(run, "term string, t long, c long").groupBy("term")
              .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t >= 3"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(c / (clean + 1))
    low = odds - 2.58 * F.sqrt(1 / t + 1 / c)
    rows = (counts.select("term", low.alias("w"), (odds - F.log(F.lit(least_odds))).alias("o")).filter("w > 0 and o > 0")
            .orderBy(F.desc("w"), "term").limit(size).collect())
    return {r["term"]: float(r["w"]) for r in rows}


def with_features(rows: DataFrame, text_col: str, lexicon: dict[str, float], names: list[str]) -> DataFrame:
    """All columns of ``rows`` and one double per feature."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(lexicon)
        for part in slices(batches, at):
            made = np.array([f.of(t or "") for t in part.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(made[:, i]) for i in range(len(FEATURES))]],
                                             names=[*part.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


class ToxicityModel:
    """Lexicon, trees and calibration; ``base`` alone if only one class was seen."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        """``rows`` with a double column ``out`` between 0 and 1."""
        if self.trees is None:
            return rows.withColumn(out, F.lit(self.base))
        taken = [*rows.columns, out]
        names = [fresh(taken, n) for n in FEATURES]
        vector, raw, prob, label, p1 = (fresh(taken, n) for n in ("vector", "raw", "probability", "prediction", "p1"))
        made = with_features(rows, text_col, self.lexicon, names)
        made = VectorAssembler(inputCols=names, outputCol=vector).transform(made)
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(label)
        made = trees.transform(made).withColumn(p1, vector_to_array(F.col(prob))[1])
        calibrated = F.col(p1)
        edges, values = self.calibration
        if edges:  # isotonic steps with linear interpolation between them
            calibrated = F.lit(values[-1])
            for i in range(len(edges) - 2, -1, -1):
                a, b, u, v = edges[i], edges[i + 1], values[i], values[i + 1]
                between = F.lit(u) + (F.col(p1) - a) * ((v - u) / (b - a)) if b > a else F.lit(v)
                calibrated = F.when(F.col(p1) < b, between).otherwise(calibrated)
            calibrated = F.when(F.col(p1) <= edges[0], F.lit(values[0])).otherwise(calibrated)
        return made.select(*[col(c) for c in rows.columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), calibrated)).alias(out))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = 20_000, lexicon_size: int = 2000, trees: int = 20, depth: int = 4, seed: int = 7) -> ToxicityModel:
    """Learn from at most ``sample_rows`` rows of labelled ids that are not held out (also where an id repeats)."""
    spark = docs.sparkSession
    one = (labels.filter(col(label_col).isNotNull() & ~held_out(id_col)).groupBy(col(id_col).alias("id"))
           .agg(F.max(col(label_col).cast("int")).alias("y")).filter("id is not null and y in (0, 1)"))
    pick = one.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stored(bounded_sample(texts, pick, sample_rows).select("id", "text", "y"), "toxicity-sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return ToxicityModel({}, None, None, float(base))
    lexicon = learn_lexicon(sample, lexicon_size)
    names = [f"x_{n}" for n in FEATURES]
    table = with_features(sample, "text", lexicon, names).select("id", F.col("y").cast("double").alias("y"), *names)
    table = stored(table.coalesce(max(1, spark.sparkContext.defaultParallelism)), "toxicity-features")
    table = VectorAssembler(inputCols=names, outputCol="vector").transform(table)
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4))
    train, rest = table.filter(part < 3), table.filter(part == 3)
    if train.select("y").distinct().count() < 2:
        train = table
    model = GBTClassifier(featuresCol="vector", labelCol="y", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2,
                          minInstancesPerNode=5, seed=seed, cacheNodeIds=False).fit(train)
    if rest.select("y").distinct().count() < 2:
        rest = table
    scored = model.transform(rest).select(vector_to_array(F.col("probability"))[1].alias("p"), "y")
    steps = IsotonicRegression(featuresCol="p", labelCol="y").fit(scored)
    edges, values = list(steps.boundaries), list(steps.predictions)
    return ToxicityModel(lexicon, model, ([float(x) for x in edges], [float(x) for x in values]), float(base))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """id, held_out, score, predicted (1 from ``threshold`` on) per row."""
    model = fit(docs, labels, id_col, text_col, **options)
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = model.score(rows, "text", "score")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
               **options) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or above; columns unchanged."""
    model = fit(docs, labels, id_col, text_col, **options)
    name = fresh(docs.columns, "toxicity")
    return model.score(docs, text_col, name).filter(F.col(name) < threshold).select(*[col(c) for c in docs.columns])

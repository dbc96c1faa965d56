"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good, the unlabelled set is web text
without a label. With class prior p and loss l the risk is

    p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)])

and where the second term falls below zero its gradient is reversed, so the
model cannot win by overfitting the positives. The prior is estimated from the
same two sets, without trusted negatives: a first model is fitted to half of
the positives; where a share q_p of the other half passes a threshold, and q_u
of the unlabelled, no more than q_u / q_p of the unlabelled can be positive.
The threshold is the one where that bound with its confidence margin is least,
and a quarter of the margin is added, since the least of noisy bounds is too low.

Features are whole-text statistics: shares of byte classes and of each ASCII
punctuation mark, and how words and lines repeat. Training reads a bounded
sample, chosen by hash (`sample` documents of each set, a parameter); scoring
is one pass over all documents without a shuffle.

Defined results: null and empty texts are scored from all-zero features; rows
with a null doc_id are scored, never trained on, and are not held out;
repeated doc_ids are scored each; a document with contradictory labels is no
trusted positive; where all texts are labelled, those that training may see are
the unlabelled set, without their labels; without any positive or unlabelled
text all scores are 0.5; an empty table gives no rows; other columns are passed
by.
"""

from __future__ import annotations

import operator
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

SAMPLE = 6000


def _classes() -> np.ndarray:
    """A 256 x classes matrix: upper case, lower case, digits, blanks, line ends, other controls, non-ASCII, then each punctuation mark."""
    m = np.zeros((256, 7 + len(string.punctuation)))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            k = 6
        elif c in string.ascii_uppercase:
            k = 0
        elif c in string.ascii_lowercase:
            k = 1
        elif c in string.digits:
            k = 2
        elif c in " \t":
            k = 3
        elif c in "\r\n":
            k = 4
        elif c in string.punctuation:
            k = 7 + string.punctuation.index(c)
        else:
            k = 5
        m[b, k] = 1
    return m


CLASSES = _classes()
WIDTH = CLASSES.shape[1] + 5


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text, each between 0 and about 2."""
    out = np.zeros(WIDTH)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, len(data), 1 << 20):
        counts += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at), minlength=256)
    out[: CLASSES.shape[1]] = np.sqrt(counts @ CLASSES / len(data))
    words = data.split()
    if words:
        out[-5] = np.log1p(len(data) / len(words)) / 3
        out[-4] = np.sqrt(sum(map(operator.eq, words, words[1:])) / len(words))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[-3] = np.sqrt(1 - len(set(lines)) / len(lines))
        pairs = len(words) // 8
        out[-2] = np.sqrt(sum(map(operator.eq, words, words[8:])) / pairs) / 3 if pairs else 0
    out[-1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by full-batch Adam."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), float(np.log(prior / (1 - prior))))
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = np.hstack((p, np.ones((len(p), 1)))), np.hstack((u, np.ones((len(u), 1))))
    w = np.zeros(WIDTH + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        wanted = -prior * (slope_p @ p) / len(p)  # of p * E_pos[l(+)], l(z) = sigmoid(-z)
        negative = su.mean() - prior * sp.mean()
        rest = (slope_u @ u) / len(u) - prior * (slope_p @ p) / len(p)
        g = (wanted + rest if negative >= 0 else -rest) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], mean, scale, float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the unlabelled set, from both sets alone: the mean of what either half of the positives gives for the other."""
    if len(positive) < 2 or not len(unlabelled):
        return 0.5
    found = []
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled, 0.5)
        p, u = np.sort(model.score(positive[1 - half :: 2])), np.sort(model.score(unlabelled))
        at = np.unique(p)
        q_p = 1 - np.searchsorted(p, at) / len(p)
        q_u = 1 - np.searchsorted(u, at) / len(u)
        margin = sum(np.sqrt(np.log(4 / delta) / (2 * n)) for n in (len(p), len(u)))
        best = int(np.argmin((q_u + margin) / q_p))
        found.append((q_u[best] + margin / 4) / q_p[best])  # the least of noisy bounds is low, by no more than the margin
    return float(min(0.99, max(0.01, np.mean(found))))


def held_out(doc_id) -> F.Column:
    """Rows whose labels training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` trusted positives and as many unlabelled documents, all outside the held-out part."""
    spark = docs.sparkSession
    seen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    marked = seen.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    usable = marked.where(~held_out(F.col("doc_id")))
    key = F.xxhash64(F.lit("pu"), "doc_id")
    ids = docs.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = [(r.doc_id, 1) for r in usable.where("low = 1").join(ids.distinct(), "doc_id", "left_semi").orderBy(key, "doc_id").limit(sample).collect()]
    draw = lambda rows: [(r.doc_id, 0) for r in rows.distinct().orderBy(key, "doc_id").limit(sample).collect()]
    chosen += draw(ids.join(marked, "doc_id", "left_anti")) or draw(ids.join(usable, "doc_id", "left_semi"))
    drawn = F.broadcast(spark.createDataFrame(chosen, "doc_id long, trusted int"))  # at most 2 * sample rows
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(drawn, "doc_id").select("doc_id", "trusted", "text")

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [features(t).astype(np.float32).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["trusted"], pa.array(x, pa.binary())], ["doc_id", "trusted", "x"])

    # repeated doc_ids would make the sample unbounded: each drawn id counts once as trusted and once as unlabelled
    rows = texts.mapInArrow(measure, "doc_id long, trusted int, x binary").groupBy("doc_id", "trusted").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = {k: np.array([np.frombuffer(r.x, np.float32) for r in rows if r.trusted == k], dtype=np.float64).reshape(-1, WIDTH) for k in (0, 1)}
    return fit(x[1], x[0], estimated_prior(x[1], x[0]))


def score(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """All columns of `docs` and the score in `column`, in one pass."""
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x), pa.float64())], names=out.names)

    return docs.mapInArrow(apply, out)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "quality score").where(F.col("quality score") >= 0.5).select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

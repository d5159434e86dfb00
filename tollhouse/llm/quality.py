"""Text quality by positive-unlabelled learning.

A logistic model on features of the text is fitted by the non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)),

from trusted positives, unlabelled texts and an estimated class prior.  When the second term
turns negative, the step goes up its gradient instead (the non-negative correction).

The prior comes from positives and unlabelled texts alone: a first model of one half of either
ranks the other half, and above the best threshold, where next to all is positive, the share of
unlabelled texts over that of positives is the prior (best bin estimation).

The fit uses bounded samples, chosen by hash; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm import words as W
from tollhouse.llm.shingles import flat_bytes, text_shingles, word_hashes

#: Most positives and most unlabelled texts that the fit uses.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 8_000, 12_000
STEPS, RATE, DECAY = 600, 0.05, 1e-4
#: Characters of text handled at once in a task.
SLICE = 500_000
#: Prior of the first model, and the chance that the bounds of the estimate do not hold.
FIRST_PRIOR, DELTA = 0.5, 0.1

_KINDS = 14
_KIND = np.zeros(256, dtype=np.int64)
_KIND[128:] = 1
for _i, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"#*$%&@^~+=", b"|<>{}[]\\/_`", b":;\"'()-", b"\t\r\x0b\x0c"]):
    _KIND[list(_chars)] = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)[_i]
N_FEATURES = _KINDS * _KINDS + 6


def features(texts: pa.Array) -> np.ndarray:
    """A row per text: square roots of the shares of pairs of neighbouring kinds of characters, and measures of length and repetition."""
    raw, bounds = flat_bytes(texts)
    n, sizes = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, N_FEATURES), dtype=np.float64)
    if n == 0:
        return out
    kinds = _KIND[raw]
    of = np.repeat(np.arange(n), sizes)
    if len(raw) > 1:
        inside = of[1:] == of[:-1]
        pairs = (of[1:] * _KINDS + kinds[:-1]) * _KINDS + kinds[1:]
        counts = np.bincount(pairs[inside], minlength=n * _KINDS * _KINDS).reshape(n, -1)
        out[:, : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(1, sizes - 1)[:, None])
    words, first = word_hashes(raw, bounds)
    n_words = np.diff(first)
    triples = np.diff(text_shingles(texts, 3)[1])
    after = np.zeros(n)
    if len(words) > 1:
        word_of = np.repeat(np.arange(n), n_words)
        same = (words[1:] == words[:-1]) & (word_of[1:] == word_of[:-1])
        after = np.bincount(word_of[1:][same], minlength=n)
    many = np.maximum(1, n_words)
    base = _KINDS * _KINDS
    out[:, base] = after / many
    out[:, base + 1] = np.sqrt(after / many)
    out[:, base + 2] = 1 - triples / np.maximum(1, n_words - 2)
    out[:, base + 3] = np.log1p(n_words) / 5
    out[:, base + 4] = np.minimum(4, sizes / many / 10)
    out[:, base + 5] = n_words == 0
    return out


class Model:
    """Weights over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in ``unlabelled`` by the scores of both: the least ratio of the shares above a threshold, with its margin of error."""
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.searchsorted(p, p) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    margin = sum(np.sqrt(np.log(4 / DELTA) / 2 / len(x)) for x in (p, u))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """A model of least non-negative risk, by Adam over whole samples; deterministic."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
    sides = [(x - mean.astype(np.float32)).astype(np.float32) for x in (positive, unlabelled)]
    scale = np.sqrt(sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in sides) / n)
    scale[scale < 1e-3] = 1e-3
    for x in sides:
        x /= scale.astype(np.float32)
        np.clip(x, -6, 6, out=x)
    p, u = sides
    w, b = np.zeros(p.shape[1] + 1), 1e-8
    first, second = np.zeros_like(w), np.zeros_like(w)

    def slope(x: np.ndarray, label: int) -> tuple[float, np.ndarray]:
        """Mean logistic loss and its gradient."""
        z = x @ w[:-1].astype(np.float32) + np.float32(w[-1])
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, -z if label else z).mean()
        d = (s - label) / len(x)
        return loss, np.concatenate([d.astype(np.float32) @ x, [d.sum()]]).astype(np.float64)

    for step in range(1, steps + 1):
        _, as_positive = slope(p, 1)
        p_loss, p_slope = slope(p, 0)
        u_loss, u_slope = slope(u, 0)
        negative, turn = u_loss - prior * p_loss, u_slope - prior * p_slope
        gradient = prior * as_positive + turn if negative >= 0 else -turn
        gradient = gradient + decay * np.concatenate([w[:-1], [0]])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + b)
    return Model(mean, scale, w[:-1], float(w[-1]))


def held_out(key: Column) -> Column:
    """Whether a row is kept from the fit: crc32 of the key as text is a multiple of 5 (null: the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def _sampled(keys: DataFrame, most: int) -> DataFrame:
    return keys.distinct().orderBy(F.xxhash64("key"), "key").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> Model | None:
    """The model of the rows that are not held out; None without positives.

    Of the labels only 1 is used; the prior is estimated from positives and unlabelled texts.
    At most ``positives`` and ``unlabelled`` keys are read; of several texts under one key
    (or labels of one) one counts.  Null keys and null labels take no part; an empty table
    of documents or labels gives None.
    """
    trusted = labels.select(F.col(key_col).alias("key"), F.col(label_col).alias("mark")).filter((F.col("mark") == 1) & F.col("key").isNotNull()).filter(~held_out(F.col("key")))
    rows = docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).filter(~held_out(F.col("key")) & F.col("key").isNotNull())
    ones = _sampled(trusted.select("key"), positives).withColumn("kind", F.lit(1))
    wild = _sampled(rows.select("key"), unlabelled).withColumn("kind", F.lit(0))
    # Both samples are bounded by the parameters: 16 bytes a key.
    wanted = F.broadcast(ones.unionByName(wild))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for a, b in W.slices(batch["text"], SLICE):
                x = features(batch["text"].slice(a, b - a)).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch["key"].slice(a, b - a), batch["kind"].slice(a, b - a), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "kind", "x"])

    kind = docs.schema[key_col].dataType.simpleString()
    found = rows.join(wanted, "key").select("key", "kind", "text").mapInArrow(run, f"key {kind}, kind int, x binary")
    found = found.groupBy("key", "kind").agg(F.min("x").alias("x")).toArrow().sort_by([("kind", "descending"), ("key", "ascending")])
    x = np.frombuffer(b"".join(found["x"].to_pylist()), "<f4").reshape(-1, N_FEATURES)
    n = pc.sum(found["kind"]).as_py() or 0
    p, u = x[:n], x[n:]
    if not len(p) or not len(u):
        return None
    if min(len(p), len(u)) < 2:
        return fit_nnpu(p, u, FIRST_PRIOR)
    first = fit_nnpu(p[::2], u[::2], FIRST_PRIOR)
    return fit_nnpu(p, u, estimated_prior(first.score(p[1::2]), first.score(u[1::2])))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with the score of each whole text; null is empty, and empty texts are scored too.

    Without a model every score is 0.5.  A column named ``out`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for a, b in W.slices(batch["__text"], SLICE):
                part = batch.slice(a, b - a)
                scores = np.full(b - a, 0.5) if model is None else model.score(features(part["__text"]))
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(scores)], [*names, out])

    return given.mapInArrow(run, given.drop("__text").schema.add(out, "double"))


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network on counts of what
texts are made of, by the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss, so the sigmoid of the output estimates the probability
of the positive class.  Where the bracket is negative its gradient is turned
round, as in the method's published form.  No negative example is used.  The
class prior is estimated from the two samples alone: for every set A of texts,
P_unl(A) >= prior * P_pos(A), so the least ratio over upper level sets of a
positive-against-unlabelled score estimates it from above, and its standard
error is taken off.  Each half of the samples is scored by a model of the other.

Both samples are bounded, by default to ``POSITIVES`` and ``UNLABELLED`` different
rows, chosen by their hash; both are parameters of ``learn``.  Of each row only
``FEATURES`` numbers reach the driver.  Scoring reads every whole text.

Defined results: null and empty texts have one line, all other counts 0, and the
score of that point; without positives the score is 0; repeated rows are each scored; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.spread import spread
from . import style
from .crf import Adam
from .language import pieces_of
from .shared import row_hash, trimmed

POSITIVES = 3000
UNLABELLED = 6000
THRESHOLD = 0.3
HIDDEN = 24
STEPS = 600
BATCH = 1024
#: Level sets with less than this share of the positives don't count for the prior.
LEAST_SHARE = 0.3
#: Texts of at most so many bytes together are counted at once.
TOGETHER = 1 << 20


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES)"""
    t = style.read(column)
    c = t.counts.astype(np.float64)
    words = np.diff(t.word_at).astype(np.float64)
    some = np.maximum(words, 1)
    letters = np.maximum(c[:, style.UPPER] + c[:, style.LOWER] + c[:, style.LEAD], 1)
    inside = c.sum(axis=1) - c[:, style.CONTINUATION]
    chars = np.maximum(inside, 1)
    lines = np.diff(t.line_at).astype(np.float64)
    has = np.flatnonzero(lines)
    total = lambda x: np.add.reduceat(x, t.line_at[:-1][has]) if len(has) else np.zeros(0)
    by_text = lambda x: np.bincount(has, weights=total(x), minlength=len(words)) if len(words) else np.zeros(0)
    lw = np.maximum(t.line_words, 1)
    lc = t.line_counts
    odd = lambda k, least: by_text(np.where(lc[:, k] / lw > least, t.line_words, 0).astype(np.float64)) / some
    out = [
        np.log1p(words),
        (inside - c[:, style.SPACE] - c[:, style.NEWLINE]) / some,
        c[:, style.UPPER] / letters,
        c[:, style.LEAD] / letters,
        c[:, style.SYMBOL] / some,
        c[:, style.PIPE] / some,
        c[:, style.BANG] / some,
        c[:, style.STOP] / some,
        c[:, style.OTHER] / chars,
        c[:, style.DIGIT] / chars,
        np.log1p(lines),
        words / np.maximum(lines, 1),
        t.distinct / some,
        t.repeated / some,
        by_text(t.line_echo.astype(np.float64)) / some,
        by_text(t.line_seen.astype(np.float64)) / np.maximum(lines, 1),
        odd(style.SYMBOL, 0.5),
        odd(style.PIPE, 0.3),
        odd(style.BANG, 0.5),
        by_text(np.where(lc[:, style.UPPER] > 4 * lc[:, style.LOWER], t.line_words, 0).astype(np.float64)) / some,
        by_text(np.where(t.line_echo * 2 > t.line_words, t.line_words, 0).astype(np.float64)) / some,
        np.minimum(words, 50) / 50,
    ]
    return np.stack(out, axis=1)


FEATURES = 22


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]
    prior: float

    def output(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ self.params["in"] + self.params["bias"]) @ self.params["out"] + self.params["level"]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.output(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives, the bracket) of outputs for positives and for unlabelled texts; the bracket may be negative."""
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def descent(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What is followed downwards: the gradient of both terms by the outputs, or that of the bracket turned round where it is negative."""
    up, down = (sigmoid(gp) - 1) / len(gp), sigmoid(gp) / len(gp)  # of the two losses on positives
    unl = sigmoid(gu) / len(gu)
    if risk(gp, gu, prior)[1] >= 0:
        return prior * (up - down), unl
    return prior * down, -unl


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> dict[str, np.ndarray]:
    """Weights that minimise the risk for a prior, or tell positives from unlabelled if it is None."""
    rng = np.random.default_rng(seed)
    n = pos.shape[1]
    p = {"in": rng.normal(0, n**-0.5, (n, HIDDEN)), "bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "level": np.zeros(1)}
    adam = Adam(p, 0.01)
    for _ in range(STEPS):
        a, b = pos[rng.integers(len(pos), size=BATCH)], unl[rng.integers(len(unl), size=BATCH)]
        x = np.concatenate([a, b])
        hidden = np.tanh(x @ p["in"] + p["bias"])
        g = hidden @ p["out"] + p["level"]
        if prior is None:
            d = np.concatenate([sigmoid(g[:BATCH]) - 1, sigmoid(g[BATCH:])]) / BATCH
        else:
            d = np.concatenate(descent(g[:BATCH], g[BATCH:], prior))
        back = np.outer(d, p["out"]) * (1 - hidden**2)
        adam.step({"in": x.T @ back + 1e-4 * p["in"], "bias": back.sum(axis=0), "out": hidden.T @ d + 1e-4 * p["out"], "level": np.array([d.sum()])})
    return p


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least ratio P_unl(A) / P_pos(A) over sets A = {score >= t} with enough positives, less its standard error."""
    cuts = np.quantile(pos, np.linspace(0, 1 - LEAST_SHARE, 30))
    a, b = np.maximum((pos[:, None] >= cuts).mean(axis=0), 1e-9), np.maximum((unl[:, None] >= cuts).mean(axis=0), 1e-9)
    least = np.argmin(b / a)
    a, b = a[least], b[least]
    error = b / a * (max(0.0, 1 - b) / (b * len(unl)) + max(0.0, 1 - a) / (a * len(pos))) ** 0.5
    return float(np.clip(b / a - error, 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, seed: int = 11) -> Model:
    both = np.concatenate([pos, unl])
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-6, {}, prior or 0.5)
    zp, zu = (np.clip((x - model.center) / model.scale, -8, 8) for x in (pos, unl))
    if prior is None:
        output = {}
        for half in (0, 1):
            own = [np.arange(len(z)) % 2 == half if len(z) > 1 else np.ones(1, dtype=bool) for z in (zp, zu)]
            rest = [z[~o] if len(z) > 1 else z for z, o in zip((zp, zu), own)]
            model.params = _fit(*rest, None, seed)
            output[half] = [model.output(x[o]) for x, o in zip((pos, unl), own)]
        model.prior = estimate_prior(*(np.concatenate([output[0][k], output[1][k]]) for k in (0, 1)))
    model.params = _fit(zp, zu, model.prior, seed)
    return model


def learn(docs: DataFrame, positives: DataFrame, may_learn: Column, prior: float | None = None, key: str = "doc_id", text: str = "text", most_positives: int = POSITIVES, most_unlabelled: int = UNLABELLED) -> Model | None:
    """A model from rows that ``may_learn`` holds for; ``positives`` has the keys of trusted ones.

    ``prior``: the share of positives, estimated if None.  ``most_positives`` and
    ``most_unlabelled``: different rows (key, text) of the two samples, chosen
    by their hash.
    """
    rows = docs.where(may_learn).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", row_hash(rows))
    keys = rows.select("id", "h")
    first = lambda df, n: df.select("h").distinct().orderBy("h").limit(n)
    pos = first(keys.join(positives.select(F.col(key).alias("id")), "id", "left_semi"), most_positives).withColumn("trusted", F.lit(True))
    unl = first(keys, most_unlabelled).withColumn("trusted", F.lit(False))
    chosen = pos.unionByName(unl).groupBy("h").agg(F.collect_set("trusted").alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 0, TOGETHER):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["h", "samples", "x"])

    joined = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # most_positives + most_unlabelled hashes at most
    got = joined.select("text", "h", "samples").mapInArrow(trimmed(run), "h bigint, samples array<boolean>, x array<double>").collect()
    got.sort(key=lambda r: r["h"])
    one, other = (np.array([r["x"] for r in got if which in r["samples"]]).reshape(-1, FEATURES) for which in (True, False))
    rng = np.random.default_rng(5)
    return train(rng.permutation(one), rng.permutation(other), prior) if len(one) and len(other) else None


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, TOGETHER):
                s = sent.value.score(features(part.column(1))) if sent.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], [key, "score"])

    return spread(docs.select(key, text)).mapInArrow(trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs with at least that score, with their columns; all of them without a model."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, at, TOGETHER):
                yield part.filter(pa.array(sent.value.score(features(part.column(at))) >= threshold))

    return spread(docs).mapInArrow(trimmed(run), docs.schema)

"""Document quality by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else is unlabelled web text, in which an unknown
share is good too. A small network is trained to minimise the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): the negative class is never labelled, its risk is what the unlabelled
text has beyond the share pi of positives, and that difference is kept from going below zero. The prior pi is estimated first, from a classifier that
tells positives from unlabelled text: among score ranges from the top down, positives are at most as
frequent in unlabelled text as the smallest ratio of both tails says. Where reviewed rows of both kinds exist, their share of good
ones is a second estimate; the smaller one counts, as a prior that is too large hides bad text.

Features are statistics of the whole text only. The network is fitted on at most SAMPLE positives and SAMPLE unlabelled
rows, those with the smallest hash of their id; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SPACES, documents, fold, hashed_sample, stage, strings, table

#: Bound on each side of the rows that the network is fitted on.
SAMPLE = 12_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 2000, 512, 3e-3, 1e-4
THRESHOLD = 0.3

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\x0b\f\r", ".", ",", ";:", "!", "?", "'\"", "()[]{}", "-_", "|", "&", "%", "$", "#", "*", "@/\\", "<>=+~^`"]
_GROUP = np.full(256, len(_GROUPS), np.intp)
for _i, _chars in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _chars]] = _i
_GROUP[128:] = len(_GROUPS) + 1
N_GROUPS = len(_GROUPS) + 2
N_FEATURES = 2 * N_GROUPS + 15


def features(text: str) -> np.ndarray:
    """Shares of character groups, and figures of words, repetition and lines; all of the whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(_GROUP, np.bincount(data, minlength=256), N_GROUPS) / max(1, len(data))
    words = text.split()
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    ending = sum(line.rstrip(SPACES)[-1:] in ".!?" for line in lines if line.strip())
    full = sum(1 for line in lines if line.strip())
    capital = sum(w[0].isupper() for w in words)
    lower = sum(w.islower() for w in words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    ended = sum(not w[-1].isalnum() for w in words)
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words)
    most = max(counts.values(), default=0)
    rest = [
        np.log1p(len(text)),
        np.log1p(n),
        len(text) / (n + 1),
        len(counts) / (n + 1),
        most / (n + 1),
        same / (n + 1),
        capital / (n + 1),
        lower / (n + 1),
        upper / (n + 1),
        ended / (n + 1),
        odd / (n + 1),
        np.log1p(full),
        len(set(lines)) / len(lines),
        ending / (full + 1),
        np.log1p(n / (full + 1)),
    ]
    return np.concatenate([share, np.sqrt(share), rest])


class Network:
    """One hidden layer; inputs are standardised by the unlabelled sample."""

    def __init__(self, sample: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = sample.mean(0), sample.std(0) + 1e-3
        n = sample.shape[1]
        self.weights = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.first, self.second = ([np.zeros_like(w) for w in self.weights] for _ in "mv")
        self.steps = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.weights[0] + self.weights[1])
        return hidden, hidden @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(self.standard(x))[1].clip(-30, 30)))

    def step(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step, given the slope of the risk by each row's output."""
        inner = np.outer(slope, self.weights[2]) * (1 - hidden**2)
        grads = [x.T @ inner + DECAY * self.weights[0], inner.sum(0), hidden.T @ slope + DECAY * self.weights[2], np.array([slope.sum()])]
        self.steps += 1
        for w, g, m, v in zip(self.weights, grads, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def batches(p: np.ndarray, u: np.ndarray, draw: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """STEPS pairs of random batches, whatever the sample's size."""
    for _ in range(STEPS):
        yield p[draw.integers(0, len(p), BATCH)], u[draw.integers(0, len(u), BATCH)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int = 1) -> Network:
    """Without a prior: positives against unlabelled rows. With it: the non-negative risk, logistic loss."""
    net, draw = Network(u, seed), np.random.default_rng(seed)
    p, u = net.standard(p), net.standard(u)
    for a, b in batches(p, u, draw):
        x = np.concatenate([a, b])
        hidden, out = net.forward(x)
        good, web = sigmoid(out[: len(a)]), sigmoid(out[len(a) :])
        if prior is None:
            slope = np.concatenate([(good - 1) / len(a), web / len(b)])
        else:
            # loss for "negative" is softplus(out), with slope sigmoid(out); for "positive" softplus(-out)
            rest = np.logaddexp(0, out[len(a) :]).mean() - prior * np.logaddexp(0, out[: len(a)]).mean()
            negative = np.concatenate([-prior * good / len(a), web / len(b)])
            # below zero the step leads back from the negative risk alone
            slope = negative + np.concatenate([prior * (good - 1) / len(a), np.zeros(len(b))]) if rest >= 0 else -negative
        net.step(x, hidden, slope)
    return net


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in unlabelled rows, from halves that the classifier has not seen."""
    net = train(p[::2], u[::2], None)
    good, web = np.sort(net.score(p[1::2])), np.sort(net.score(u[1::2]))
    if not len(good) or not len(web):
        return 0.5
    share = lambda s, t: 1 - np.searchsorted(s, t, side="left") / len(s)
    cuts = good[: max(1, int(len(good) * 0.9)) : max(1, len(good) // 200)]
    slack = np.sqrt(np.log(40) / (2 * len(web)))  # of a tail's share, so that thin tails don't win by chance
    ratios = [(share(web, t), share(good, t)) for t in cuts]
    best = min(ratios, key=lambda r: (r[0] + slack) / max(1e-9, r[1]))
    return float(np.clip(best[0] / max(best[1], 1e-9), 0.01, 0.99))


FEATURES = "doc_id long, features array<float>"


def feature_rows(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            rows = [features(text).astype(np.float32) for text in strings(batch.column("text"))]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat)).cast(kind)], ["doc_id", "features"])

    return documents(df).mapInArrow(run, FEATURES)


def bounded(rows: DataFrame) -> np.ndarray:
    kept = hashed_sample(rows, "doc_id", SAMPLE)
    return np.array([r["features"] for r in kept], float).reshape(len(kept), N_FEATURES)


def fit(staged: DataFrame, labels: DataFrame, learn: str) -> Network | None:
    """None if there is nothing to learn from."""
    known = labels.where(learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    mine = staged.where("doc_id IS NOT NULL").where(learn)
    p = bounded(mine.join(known.where("quality = 1"), "doc_id", "left_semi"))
    u = bounded(mine)
    if not len(p) or not len(u):
        return None
    good, reviewed = known.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("quality")).first()
    shares = [(good + 1) / (reviewed + 2)] if good < reviewed else []
    return train(p, u, min([estimated_prior(p, u), *shares]))


def quality(df: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """(doc_id, score, predicted) of every row of (doc_id, text).

    Labels (doc_id, quality) count where the SQL condition ``learn`` on doc_id holds; of repeated labels the better one does,
    null labels and labels of unknown ids do not. A null or empty text is scored by the features of the
    empty text. Without any positive to learn from every score is 0.5. Repeated rows and null ids are scored like others; an empty
    table gives no rows; extra columns are ignored.
    """
    staged = stage(feature_rows(df), "op3-features")
    net = fit(staged, labels, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_FEATURES).astype(float)
            score = net.score(x) if net is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return staged.mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(df: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """The rows of ``df``, all columns, that score THRESHOLD or more; see ``quality``. Rows are judged where they are."""
    net = fit(stage(feature_rows(df), "op3-features"), labels, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and net is not None:
                rows = np.array([features(text) for text in strings(batch.column("text"))], np.float32)
                batch = batch.filter(pa.array(net.score(rows.astype(float)) >= THRESHOLD))
            yield batch

    return df.mapInArrow(run, df.schema)


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"NOT ({HELD_OUT})")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

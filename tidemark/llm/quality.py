"""Quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: with class prior ``p``, the risk of a scorer on
positives ``P`` and unlabelled rows ``U`` is
``p * loss(P, +) + max(0, loss(U, -) - p * loss(P, -))``.  The second part
estimates the risk on the unseen negatives; where it turns negative the model
has begun to fit noise, so the step goes back along it instead (non-negative
correction).  The prior is estimated from positives and unlabelled rows too:
above any score, the share of unlabelled rows is at least ``p`` times that of
positives, and near to it where the score leaves no negatives.  Rows labelled
negative are never used.  The scorer is a small network on figures of a text's
surface (kinds of characters, shapes of words, repetition of words and lines)
and on its words and pairs of words, hashed.

The fit uses bounded samples, chosen by a hash of the row's id; scoring reads
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops
from tidemark.llm.shared import bounded_sample

#: Labelled positives, and unlabelled rows, that a fit may use at most.
SAMPLE = 20_000
FOLDS = 5


def _classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)  # other ASCII
    out[[*range(ord("a"), ord("z") + 1)]] = 0
    out[[*range(ord("A"), ord("Z") + 1)]] = 1
    out[[*range(ord("0"), ord("9") + 1)]] = 2
    out[[ord(" "), ord("\t")]] = 3
    out[[10, 13]] = 4
    out[[ord(c) for c in ".,;:'\"-()"]] = 5
    out[[ord(c) for c in "!?"]] = 7
    out[128:192] = 8  # continuation bytes
    out[192:] = 9  # first bytes of other letters
    return out


_CLASS = _classes()
_N_CLASSES = 10
_QUARTERS = 4
#: Buckets of hashed words, and of hashed pairs of words.
_BUCKETS = 64
#: How much less a bucket counts at first than a figure of the surface: there are many, each with little to say.
_DAMPED = 8
N_FEATURES = _N_CLASSES + 16 + 2 * _BUCKETS


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of figures per text of a block; an empty text has zeros."""
    n = len(at) - 1
    rows = np.arange(n)
    size = np.diff(at)
    kind = _CLASS[data]
    counts = np.bincount(np.repeat(rows, size) * _N_CLASSES + kind, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    out = np.zeros((n, N_FEATURES))
    out[:, :_N_CLASSES] = counts / np.maximum(size, 1)[:, None]

    start, end, first = textops.words(data, at)
    count = np.diff(first)
    many = np.maximum(count, 1)
    owner = np.repeat(rows, count)
    share = lambda flag: np.bincount(owner[flag], minlength=n) / many
    length = end - start
    last, head = kind[end - 1], kind[start]
    second = kind[np.minimum(start + 1, end - 1)]
    odd = (last == 6) | (last == 7) | ((head == 1) & (second == 1) & (length > 1))
    hashed = textops.span_hash(textops.prefix_hash(textops.ascii_lower(data)), start, end)
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    key, example, times = np.unique(hashed ^ textops.mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    distinct = np.bincount(owner[example], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner[example], times)
    quarter = (np.arange(len(start)) - first[owner]) * _QUARTERS // many[owner]
    bad = np.bincount(owner[odd | same] * _QUARTERS + quarter[odd | same], minlength=n * _QUARTERS).reshape(n, _QUARTERS)
    per = np.bincount(owner * _QUARTERS + quarter, minlength=n * _QUARTERS).reshape(n, _QUARTERS)

    stop = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1][size > 0], stop + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(at, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), at[line_row + 1]) if len(line_start) else line_start
    lines = np.bincount(line_row, minlength=n)
    line_hash = textops.span_hash(textops.prefix_hash(data), line_start, line_end)
    _, line_example = np.unique(line_hash ^ textops.mix(line_row.astype(np.uint64) + np.uint64(7)), return_index=True)
    line_distinct = np.bincount(line_row[line_example], minlength=n)

    mean = np.bincount(owner, length, n) / many
    figures = [
        np.log1p(size),
        np.log1p(count),
        mean,
        np.sqrt(np.maximum(0, np.bincount(owner, length**2.0, n) / many - mean**2)),
        distinct / many,
        distinct / np.sqrt(many),
        most / many,
        share(same),
        share(last == 6),
        share(last == 7),
        share((head == 1) & (second == 1) & (length > 1)),
        share((length == 1) & (head >= 5)),
        share(odd),
        (bad / np.maximum(per, 1)).max(axis=1),
        1 - line_distinct / np.maximum(lines, 1),
        np.log1p(size / np.maximum(lines, 1)),
    ]
    out[:, _N_CLASSES : _N_CLASSES + 16] = np.stack(figures, axis=1)
    together = owner[1:] == owner[:-1]
    pair = textops.mix(hashed[:-1] * np.uint64(3) + hashed[1:])[together]
    for k, (own, key) in enumerate(((owner, hashed), (owner[:-1][together], pair))):
        bucket = (key % np.uint64(_BUCKETS)).astype(np.int64)
        shares = np.bincount(own * _BUCKETS + bucket, minlength=n * _BUCKETS).reshape(n, _BUCKETS) / many[:, None]
        out[:, N_FEATURES - (2 - k) * _BUCKETS : N_FEATURES - (1 - k) * _BUCKETS] = np.sqrt(shares)
    return out


@dataclass
class Scorer:
    """Standardised figures through one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk(weights: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """Risk on positives, estimated risk on negatives, and the step's slope: of their sum, or away from the second where it is negative."""
    x = np.concatenate([xp, xu])
    inner = np.tanh(x @ weights[0] + weights[1])
    g = inner @ weights[2] + weights[3][0]
    yes = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    n, m = len(xp), len(xu)
    soft = np.logaddexp(0, g)  # loss of calling a row negative
    positive = prior * np.logaddexp(0, -g[:n]).mean()
    negative = soft[n:].mean() - prior * soft[:n].mean()
    slope_n = np.concatenate([-prior * yes[:n] / n, yes[n:] / m])
    slope_p = np.concatenate([prior * (yes[:n] - 1) / n, np.zeros(m)])
    d = slope_p + slope_n if negative >= 0 else -slope_n
    back = np.outer(d, weights[2]) * (1 - inner**2)
    return positive, negative, [x.T @ back, back.sum(axis=0), inner.T @ d, np.array([d.sum()])]


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, seed: int = 5) -> Scorer:
    """Minimises the non-negative unbiased risk with logistic loss, by mini-batches of both samples and Adam."""
    rng = np.random.default_rng(seed)
    n = len(positive) + len(unlabelled)
    mean = sum(x.sum(axis=0, dtype=np.float64) for x in (positive, unlabelled)) / n
    scale = np.sqrt(np.maximum(0, sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positive, unlabelled)) / n - mean**2)) + 1e-6
    scale[_N_CLASSES + 16 :] *= _DAMPED
    p, u = (np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -8, 8) for x in (positive, unlabelled))
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    steps = max(1, min(len(p), len(u)) // 256)
    for t in range(1, epochs * steps + 1):
        grads = risk(weights, p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 256)], prior)[2]
        grads[0] += 1e-4 * weights[0]
        grads[2] += 1e-4 * weights[2]
        for w, m, gr in zip(weights, moment, grads, strict=True):
            m[0] += 0.1 * (gr - m[0])
            m[1] += 0.001 * (gr**2 - m[1])
            w -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, weights)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The class prior from the scores of positives and unlabelled rows that the scorer was not fitted on.

    The ratio of the two shares above a score, at the score where it is
    smallest with its margin of error (so not where few rows are left).
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1, 400)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(np.log(4 / doubt) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / doubt) / (2 * len(positive)))
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """Estimates the prior on one half of both samples with a scorer fitted on the other, then fits on all."""
    half = slice(None, None, 2), slice(1, None, 2)
    first = fit_positive_unlabelled(positive[half[0]], unlabelled[half[0]], 0.5, epochs=20)
    rest = positive[half[1]] if len(positive) > 1 else positive, unlabelled[half[1]] if len(unlabelled) > 1 else unlabelled
    return fit_positive_unlabelled(positive, unlabelled, estimated_prior(*(first.margin(x) for x in rest)))


def held_out(doc_id: str | Column) -> Column:
    """True where ``crc32(doc_id as text) mod 5`` is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % FOLDS == 0


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            x = features(data, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("role"), part.column("h"), lists], names=["doc_id", "role", "h", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from ``labels(doc_id, quality)`` of the learning folds and the texts of ``docs``.

    At most ``sample`` documents labelled 1 and ``sample`` unlabelled ones are
    fitted, by smallest hash of the id; labels of 0 are not used, but for a
    document whose repeated labels differ, which is no trusted positive.
    Without a positive with a text the scorer gives 0.5 to every text.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    blank = Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    first = lambda frame, seed: bounded_sample(frame.select("doc_id").distinct(), ["doc_id"], sample, seed)
    roles = first(known.where("quality = 1"), 1).withColumn("role", F.lit(1)).union(first(docs.where("doc_id IS NOT NULL").where(~held_out("doc_id")), 2).withColumn("role", F.lit(2)))
    # at most two samples of ids: bounded, so it may be sent to every executor
    chosen = docs.select("doc_id", "text").join(F.broadcast(roles.groupBy("doc_id").agg(F.sum("role").cast("int").alias("role"))), "doc_id")
    # figures, not texts, move from here on: rows that repeat an id and a text count once, and what comes here is bounded even if ids repeat
    figures = chosen.select("doc_id", "role", "text", F.xxhash64("text").alias("h")).mapInArrow(_figures, "doc_id long, role int, h long, x array<float>")
    figures = figures.groupBy("doc_id", "h").agg(F.first("role").alias("role"), F.first("x").alias("x"))
    rows = figures.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(2 * sample).select("role", "x").toArrow()
    if not rows.num_rows:
        return blank
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, N_FEATURES)
    role = rows.column("role").to_numpy()
    positive, unlabelled = x[role & 1 == 1], x[role & 2 == 2]
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else blank


def _scored(batches: Iterator[pa.RecordBatch], scorer: Scorer, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(features(data, at)))], names=[*part.schema.names, name])


def score_documents(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """``docs`` with one more column: how likely label 1 is, by the text alone.

    Texts are read whole; a null text scores as an empty one.  Every row is
    kept, repeated ones too, and other columns pass through; one that has the
    new column's name is replaced.  An empty table gives an empty result.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(partial(_scored, scorer=scorer, name=name), schema)

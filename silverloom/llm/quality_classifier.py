"""Quality classifier from compression (operator 1).

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed
whole with both; the normalised difference of the sizes, together with the two compression ratios
and the length, goes through a logistic calibration fitted on labelled texts that no dictionary saw,
weighted to the class shares of all training labels.

The fit uses at most ``sample`` labelled documents of each class (in hash order of their ids, so the
choice doesn't depend on how the tables are dealt out); scoring is one pass over the texts.

Defined results: a null text is an empty one, and an empty text gets the calibrated score of length
zero; without labels of both classes every score is the good share (0.5 without any label); a
document labelled more than once is good if any label says so; null labels are ignored; repeated
rows each get their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, schema_with, text_bytes

SAMPLE, DICTIONARY_BYTES, LEVEL, THRESHOLD = 4000, 112_640, 3, 0.3


@dataclass
class QualityModel:
    """Dictionaries (bad, good) and the calibration; no dictionaries: the prior alone."""

    dictionaries: list[bytes] = field(default_factory=list)
    raw: bool = False
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_AUTO
        out = []
        for content in self.dictionaries:
            made = zstandard.ZstdCompressionDict(content, dict_type=kind)
            made.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))
        return out

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -8, 8)
        cross = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.column_stack([np.ones(len(z)), z, *cross])

    def score(self, texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
        if not compressors:
            return np.full(len(texts), self.prior)
        return sigmoid(self.design(features(texts, compressors)) @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Normalised size difference, the two ratios, log length."""
    bad, good = ([len(c.compress(x)) for x in texts] for c in compressors)
    bad, good, n = np.array(bad, float), np.array(good, float), np.array([len(x) for x in texts], float)
    return np.column_stack([(bad - good) / np.maximum(bad, good), good / (n + 1), bad / (n + 1), np.log1p(n)])


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, halved until the loss falls."""
    w = np.zeros(x.shape[1])
    loss = lambda w: float(share @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)) + ridge * w[1:] @ w[1:] / 2)
    pull = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + np.diag(pull + 1e-8), x.T @ (share * (y - p)) - pull * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-9 * max(1, now):
            break
        now = loss(w)
    return w


def train_dictionaries(texts: list[list[bytes]], size: int) -> tuple[list[bytes], bool]:
    """zstandard's trained dictionaries; of too little text, the text itself."""
    try:
        return [zstandard.train_dictionary(min(size, max(256, sum(map(len, x)) // 4)), x).as_bytes() for x in texts], False
    except zstandard.ZstdError:
        return [b"".join(x)[-size:] or b"\0" * 8 for x in texts], True


def fit(good: list[bytes], bad: list[bytes], prior: float, size: int = DICTIONARY_BYTES) -> QualityModel:
    """Even places train the dictionaries, odd ones the calibration; prior: the share of good labels."""
    if min(len(good), len(bad)) < 2:
        return QualityModel(prior=prior)
    dictionaries, raw = train_dictionaries([bad[::2], good[::2]], size)
    model = QualityModel(dictionaries, raw, prior=prior)
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    x = features(good[1::2] + bad[1::2], model.compressors())
    model.middle, model.spread = x.mean(0), x.std(0) + 1e-6
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.weights = fit_logistic(model.design(x), y, share)
    return model


def train_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on ``labels`` (doc_id, quality), which must hold the training rows only."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("mark"))
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    if len(counts) < 2:
        return QualityModel(prior=float(next(iter(counts), 0.5)))
    order = F.xxhash64("label_id")
    picked = marks.filter("mark = 1").orderBy(order, "label_id").limit(sample).unionByName(marks.filter("mark = 0").orderBy(order, "label_id").limit(sample))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # 2 x sample ids at most
    rows = sorted(texts.groupBy("label_id").agg(F.max("mark").alias("mark"), F.min("text").alias("text")).collect(), key=lambda r: r["label_id"])
    by = {m: [r["text"].encode() for r in rows if r["mark"] == m] for m in (0, 1)}
    return fit(by[1], by[0], counts[1] / (counts[0] + counts[1]))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and a score from 0 to 1 of each whole text."""
    keep = keep or ["doc_id"]
    made: list = []

    def prepare() -> None:
        made[:] = [model.compressors()]

    def each(batch: pa.RecordBatch) -> dict:
        score = model.score(text_bytes(batch.column("text")), made[0])
        return {c: batch.column(c) for c in keep} | {"score": score}

    kept = docs.select(*keep, "text")
    return map_batches(kept, schema_with(kept, keep, "score double"), each, prepare)

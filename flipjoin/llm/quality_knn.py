"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are byte trigrams (hashed), trigrams of character classes, and repeats
of recent words.  A truncated singular value decomposition of a bounded, balanced
sample of labelled documents gives the space; the labelled vectors are broadcast
(their number and width are parameters).  Every document is projected, compared with
all labelled vectors in blocks of exact cosines, and scored by the labels of the
nearest ones, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_bytes
from .labelled import labelled_sample
from .numhash import Words, text_groups

#: Labelled documents of each label that are learned from, at most.
PER_LABEL = 1500
MOD, HELD_OUT = 3, 1
TRIGRAMS, CLASSES, BACK = 2048, 8, 6
TERMS = TRIGRAMS + CLASSES**3 + BACK
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 8.0


def _classes() -> np.ndarray:
    """Class of each byte: end, space, lower, upper, digit, sentence mark, other sign, above ASCII."""
    out = np.full(256, 6, np.int32)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 7
    out[[ord(c) for c in ".,;:'-"]] = 5
    out[0] = 0
    return out


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of damped, length-normalised term counts for each text."""
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    # Two zeros after each text: a trigram that starts in it sees nothing of the next.
    data = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    at = np.arange(len(owner)) + 2 * owner
    cls = _classes()[data]
    tri = ((data[at] << 16 | data[at + 1] << 8 | data[at + 2]) * np.uint32(2654435761)) >> np.uint32(21)
    shape = (cls[at] * CLASSES + cls[at + 1]) * CLASSES + cls[at + 2]
    out[:, :TRIGRAMS] = np.bincount(owner * TRIGRAMS + tri, minlength=n * TRIGRAMS).reshape(n, -1)
    out[:, TRIGRAMS:TRIGRAMS + CLASSES**3] = np.bincount(owner * CLASSES**3 + shape, minlength=n * CLASSES**3).reshape(n, -1)
    words = Words(texts)
    for k in range(1, BACK + 1):
        again = (words.hash[k:] == words.hash[:-k]) & (words.text[k:] == words.text[:-k]) if len(words.hash) > k else np.zeros(0, bool)
        out[:, TRIGRAMS + CLASSES**3 + k - 1] = np.bincount(words.text[k:][again], minlength=n) if again.any() else 0
    out /= np.maximum(sizes, 2)[:, None].astype(np.float32)
    return np.sqrt(out)


@dataclass
class Space:
    """The fitted space: term means and weights, the projection, labelled vectors."""

    centre: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors; in doubles, so that the size of a block does not show in a score."""
        x = ((terms.astype(np.float64) - self.centre) * self.weight) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        near = self.project(terms) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.exp(SHARPNESS * (np.take_along_axis(near, top, 1).astype(np.float64) - 1))
        return (w * self.labels[top]).sum(axis=1) / w.sum(axis=1)


def fit(terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    """The space of a sample, by a randomised decomposition with a fixed seed."""
    if not len(labels):
        return Space(np.zeros(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    centre = terms.mean(axis=0)
    weight = 1 / (terms.std(axis=0) + 0.02)
    x = (terms - centre) * weight
    rng = np.random.default_rng(11)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], dimensions + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T
    space = Space(centre, weight, np.ascontiguousarray(axes, np.float64), np.zeros((0, 1)), labels.astype(np.float64))
    space.vectors = space.project(terms)
    return space


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Space:
    """Fit on at most 2 * per_label labelled rows; their term rows come to the driver."""
    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in text_groups(texts, 1 << 20):
                rows = term_counts(texts[a:b]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "y", "terms"])

    sample = labelled_sample(docs, labels, "quality", per_label, MOD, HELD_OUT).mapInArrow(run, "doc_id long, y int, terms binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["terms"]))
    terms = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(-1, TERMS)
    return fit(terms, np.array([r["y"] for r in rows], np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted.

    ``score`` (0 to 1, higher: better) is the similarity-weighted share of good labels
    among the nearest labelled vectors; ``predicted`` is 1 from 0.5 on.  Only the text is
    scored.  An empty or null text has the terms of none and is scored like any other;
    without labels every score is 0.5.  Copies of a text get the same score.  Columns of
    ``docs`` with one of the three names are replaced; an empty table gives an empty
    result.
    """
    space = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_label))

    @F.pandas_udf("double")
    def score(text):
        raw = [t.encode() for t in text]
        return pd_series([space.value.score(term_counts(raw[a:b])) for a, b in text_groups(raw, 1 << 20)])

    clean = docs.drop("held_out", "score", "predicted")
    scored = clean.withColumns({
        "held_out": crc_mod(F.col("doc_id").cast("long"), MOD) == HELD_OUT,
        "score": score(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    })
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def pd_series(parts: list[np.ndarray]):
    import pandas as pd

    return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

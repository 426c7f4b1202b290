"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its hashed
words and their beginnings; the document's score is their noisy-or, 1 - prod(1 - p).  Weights are trained
from document labels alone, so the sentences that make a document toxic are found
without being marked, and are reported with their offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_bytes
from .labelled import labelled_sample
from .numhash import Ranges, text_groups

#: Labelled documents of each label that are learned from, at most.
PER_LABEL = 2000
MOD, HELD_OUT = 5, 0
#: Lengths in bytes of the beginnings of a word that count as well.
PREFIXES = (4, 5, 6)
#: A word counts if so many toxic documents have it, at any size of the sample.
LEAST = 2
#: A word that n toxic documents have learns at n / (n + SHRINK) of the speed.
SHRINK = 4
#: 2^18 weights: the size of what is broadcast.
WEIGHT_BITS = 18


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(256, bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".!?\n"]] = True
    return letter, stop


def different(x: np.ndarray) -> np.ndarray:
    """Each number once, in order, by sorting: numpy's hashed ``unique`` takes many times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Sentences:
    """Words and beginnings in several texts as weight numbers, with their sentences."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts).lower()
        ranges = Ranges(data)
        letter, stop = _byte_kinds()
        word = letter[ranges.bytes]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stops = np.flatnonzero(stop[ranges.bytes])
        at = np.searchsorted(stops, start)
        # Sentences are the stretches between stops that hold words.
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        number = np.cumsum(new) - 1
        # A word counts as itself and by its beginnings, which inflected forms share.
        sides = [(start, end, number)]
        for k in PREFIXES:
            long = end - start > k
            sides.append((start[long], start[long] + k, number[long]))
        start, end, number = map(np.concatenate, zip(*sides))
        # Each once a sentence: it is judged by what it has, not by how often.
        self.pairs = different(number << WEIGHT_BITS | (ranges.hash(start, end) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64))
        self.sentence, self.slot = self.pairs >> WEIGHT_BITS, self.pairs & ((1 << WEIGHT_BITS) - 1)
        bounds = np.concatenate([[-1], stops, [len(data)]])
        self.start, self.end = bounds[at[new]] + 1, bounds[at[new] + 1]
        self.first_byte = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(self.first_byte, self.start, side="right") - 1


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        z = self.bias + np.bincount(s.sentence, self.weights[s.slot], minlength=len(s.start)) if len(s.start) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)) if len(p) else np.zeros(n)


def train(slot, sentence, text, y, rounds: int = 120, rate: float = 1.0, decay: float = 1e-5) -> Model:
    """Gradient ascent with momentum on the likelihood of document labels under the noisy-or.

    All weights share one step size, so words that many documents agree on lead and rare
    ones, which explain their few documents too easily, stay small.  Weights are never
    negative: a sentence offends by what it has, whatever else is said in it.
    """
    n_texts, n_sentences = len(y), len(text)
    model = Model(np.zeros(1 << WEIGHT_BITS), -5.0)
    if not n_texts or not n_sentences:
        return Model(model.weights, -30.0)
    # What one toxic document has explains its label too easily, what few have somewhat.
    documents = different(slot * n_texts + text[sentence])
    support = np.bincount(documents[y[documents % n_texts] == 1] // n_texts, minlength=1 << WEIGHT_BITS)
    often, trust = support[slot] >= LEAST, support / (support + SHRINK)
    slot, sentence = slot[often], sentence[often]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    speed, bias_speed = np.zeros(len(model.weights)), 0.0
    for t in range(rounds):
        z = model.bias + np.bincount(sentence, model.weights[slot], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        doc = np.clip(noisy_or(p, text, n_texts), 1e-9, 1 - 1e-9)
        # d log L / d z of a sentence: p (1 - P) / P in a toxic document, -p in a clean one.
        g = share[text] * np.where(y[text] == 1, p * (1 - doc[text]) / doc[text], -p)
        grad = trust * np.bincount(slot, g[sentence], minlength=len(model.weights))
        scale = rate / (np.abs(grad).max() + 1e-4)
        speed = 0.8 * speed + 0.2 * scale * (grad - decay * model.weights)
        bias_speed = 0.8 * bias_speed + 0.2 * np.clip(scale * g.sum(), -0.3, 0.3)
        model.weights = np.maximum(model.weights + speed, 0)
        model.bias += bias_speed
    return model


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Train on at most 2 * per_label labelled rows; their word numbers come to the driver."""
    def run(batches):
        for batch in batches:
            for doc_id, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), text_bytes(batch.column("text"))):
                pairs = Sentences([text]).pairs  # sent as steps: every sentence has a word, so steps are small
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([y], pa.int32()), pa.array([np.diff(pairs, prepend=0).astype(np.uint32).tobytes()], pa.binary())], names=["doc_id", "y", "pairs"])

    sample = labelled_sample(docs, labels, "toxic", per_label, MOD, HELD_OUT).mapInArrow(run, "doc_id long, y int, pairs binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["pairs"]))
    return train(*bags([np.cumsum(np.frombuffer(r["pairs"], np.uint32), dtype=np.int64) for r in rows]), np.array([r["y"] for r in rows], np.int64))


def bags(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slot and sentence of every word, text of every sentence, numbered through."""
    counts = [int(p[-1] >> WEIGHT_BITS) + 1 if len(p) else 0 for p in pairs]
    first = np.cumsum([0, *counts])
    slot = np.concatenate([p & ((1 << WEIGHT_BITS) - 1) for p in pairs]) if pairs else np.zeros(0, np.int64)
    sentence = np.concatenate([(p >> WEIGHT_BITS) + f for p, f in zip(pairs, first)]) if pairs else np.zeros(0, np.int64)
    return slot, sentence, np.repeat(np.arange(len(pairs)), counts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with held_out, score, predicted and offending.

    ``score`` is the noisy-or of the sentence scores, ``predicted`` is 1 from 0.5 on, and
    ``offending`` lists the sentences scored ``threshold`` or more as (start, end, score)
    in code points.  Sentences end at ``.!?`` and newlines; words are runs of ASCII
    letters, digits and characters above ASCII.  A text without words (null, empty) has
    score 0.  Without labels all scores are near 0.  Copies get the same result.
    Columns of ``docs`` with one of the four names are replaced; an empty table gives
    an empty result.
    """
    learned = learn(docs, labels, per_label)
    model = docs.sparkSession.sparkContext.broadcast(Model(learned.weights.astype(np.float32), learned.bias))

    @F.pandas_udf("score double, starts array<long>, ends array<long>, scores array<double>")
    def score(text: pd.Series) -> pd.DataFrame:
        raw = [t.encode() for t in text]
        return pd.concat([scored(model.value, raw[a:b], threshold) for a, b in text_groups(raw, 4 << 20)] or [scored(model.value, [], threshold)], ignore_index=True)

    clean = docs.drop("held_out", "score", "predicted", "offending")
    out = clean.withColumn("__s", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.withColumns({
        "held_out": crc_mod(F.col("doc_id").cast("long"), MOD) == HELD_OUT,
        "score": F.col("__s.score"),
        "predicted": F.when(F.col("__s.score") >= 0.5, 1).otherwise(0),
        "offending": F.arrays_zip(F.col("__s.starts").alias("start"), F.col("__s.ends").alias("end"), F.col("__s.scores").alias("score")),
    }).drop("__s")


def scored(model: Model, texts: list[bytes], threshold: float) -> pd.DataFrame:
    n = len(texts)
    s = Sentences(texts)
    p = model.sentence_scores(s)
    starts, ends, scores = ([[] for _ in range(n)] for _ in range(3))
    for i in np.flatnonzero(p >= threshold):
        d = s.text[i]
        a, b = int(s.start[i] - s.first_byte[d]), int(s.end[i] - s.first_byte[d])
        at = len(texts[d][:a].decode())
        starts[d].append(at)
        ends[d].append(at + len(texts[d][a:b].decode()))
        scores[d].append(float(p[i]))
    return pd.DataFrame({"score": np.clip(noisy_or(p, s.text, n), 0, 1), "starts": starts, "ends": ends, "scores": scores})

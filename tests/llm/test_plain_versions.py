"""Scores, neighbours and packing against versions that go one by one."""

import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flipjoin.llm import packing, quality_knn, toxicity_mil
from flipjoin.llm.common import table
from flipjoin.llm.labelled import labelled_sample
from flipjoin.llm.numhash import Ranges
from flipjoin.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


def slot(word: bytes) -> int:
    return int(Ranges(word).hash(np.array([0]), np.array([len(word)]))[0] >> np.uint64(64 - toxicity_mil.WEIGHT_BITS))


def plain_sentences(text):
    """(start, end, slots) of each sentence with a word, in code points."""
    out, at = [], 0
    for part in re.split(r"([.!?\n])", text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", part.encode().lower())
        if words:
            slots = {slot(w) for w in words} | {slot(w[:k]) for w in words for k in toxicity_mil.PREFIXES if len(w) > k}
            out.append((at, at + len(part), slots))
        at += len(part)
    return out


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


@needs_tables
def test_toxicity_scores_one_sentence_at_a_time(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity_mil.learn(docs.select("doc_id", "text"), table(spark, SMALL, "labels"))
    weights = model.weights.astype(np.float32)
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        clean, spans = 1.0, []
        for start, end, slots in plain_sentences(text):
            p = sigmoid(model.bias + sum(float(weights[s]) for s in slots))
            clean *= 1 - p
            if p >= 0.5:
                spans.append(f"{start}-{end}")
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-5)
        assert got[i]["offending"] == " ".join(spans) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_one_step_follows_the_slope_of_the_likelihood():
    """The slope is taken by small changes of one weight after the other."""
    rng = np.random.default_rng(1)
    texts = [[set(rng.integers(0, 12, 3).tolist()) for _ in range(rng.integers(1, 4))] for _ in range(40)]
    y = rng.integers(0, 2, 40)
    slots = [s for t in texts for sentence in t for s in sentence]
    sentence = [k for k, x in enumerate(x for t in texts for x in t) for _ in x]
    text = [i for i, t in enumerate(texts) for _ in t]

    def likelihood(weights, bias=-5.0):
        total = 0.0
        for t, label in zip(texts, y):
            clean = math.prod(1 - sigmoid(bias + sum(weights[s] for s in x)) for x in t)
            total += 0.5 / (y == label).sum() * math.log(1 - clean if label else clean)
        return total

    slope = [(likelihood([1e-6 * (k == j) for k in range(12)]) - likelihood([-1e-6 * (k == j) for k in range(12)])) / 2e-6 for j in range(12)]
    support = [sum(any(j in x for x in t) for t, label in zip(texts, y) if label) for j in range(12)]
    want = np.array([max(0.0, g * n / (n + toxicity_mil.SHRINK)) if n >= toxicity_mil.LEAST else 0.0 for g, n in zip(slope, support)])
    args = (np.array(slots), np.array(sentence), np.array(text), y)
    got = toxicity_mil.train(*args, rounds=1, decay=0.0).weights[:12]
    assert want.max() > 0 and got / got.max() == pytest.approx(want / want.max(), abs=1e-4)
    trained = toxicity_mil.train(*args)
    assert likelihood(trained.weights[:12], trained.bias) > likelihood([0.0] * 12)


@needs_tables
def test_quality_by_neighbours_one_by_one(spark):
    docs = table(spark, SMALL, "documents")
    space = quality_knn.learn(docs, table(spark, SMALL, "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, SMALL).collect()}
    for r in docs.collect():
        x = space.project(quality_knn.term_counts([(r["text"] or "").encode()]))[0]
        near = sorted(((sum(a * b for a, b in zip(x, v)), y) for v, y in zip(space.vectors, space.labels)), reverse=True)[:quality_knn.NEIGHBOURS]
        weights = [math.exp(quality_knn.SHARPNESS * (c - 1)) for c, _ in near]
        score = sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-5)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)


@needs_tables
def test_pieces_and_places_of_all_documents(spark):
    tokenizer = packing.encoder().tokenizer
    want = set()
    for r in table(spark, SMALL, "documents").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [(0, min(first, len(ids)))] + [(a, a + 1024) for a in range(first, len(ids), 1024)]
        want |= {(r["doc_id"], k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(cuts)}
    got = QUERIES["op5_packing"](spark, SMALL).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.03 * sum(x[3] for x in want) / 1024 + 1


@pytest.mark.parametrize("capacity,seed", [(10, 1), (37, 2), (64, 3)])
def test_sum_of_squares_computed_anew_for_every_place(capacity, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, capacity + 1, 300)
    sequence, offset = packing.pack_lengths(lengths, capacity)
    gaps: dict[int, int] = {}  # of every sequence

    def squares(changed):
        counts = defaultdict(int)
        for g in {**gaps, **changed}.values():
            if 0 < g < capacity:
                counts[g] += 1
        return sum(c * c for c in counts.values())

    for i in np.argsort(-lengths, kind="stable"):
        n, s = int(lengths[i]), int(sequence[i])
        fits = {q: g for q, g in gaps.items() if g >= n}
        if not fits:
            assert s not in gaps and offset[i] == 0  # a new one only where none has room
            gaps[s] = capacity - n
            continue
        best = min(squares({q: g - n}) for q, g in fits.items())
        assert squares({s: gaps[s] - n}) == best and offset[i] == capacity - gaps[s]
        assert gaps[s] == min(g for q, g in fits.items() if squares({q: g - n}) == best)
        gaps[s] -= n


def test_a_drawn_id_gives_one_row(spark):
    """Rows that repeat a labelled id do not grow the sample."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", 5, 1, 99).collect()
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in found) == [(1, "text 0", 1), (2, "", 1), (3, "c", 0)]

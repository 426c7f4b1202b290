"""Held-out accuracy, and language-model scores against a plain model."""

import math
import os
from collections import Counter

import brute
import numpy as np
import pytest

from flipjoin.llm import ngram_lm
from flipjoin.llm.elias_fano import EliasFano, coded, mapped, pack, prefixed
from flipjoin.llm.queries import QUERIES
from flipjoin.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


@needs_tables
def test_language_model_against_a_plain_one(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op2_language_model"](spark, SMALL).collect()}
    uni, bi = Counter(), Counter()
    for i, t in docs:
        if brute.crc_mod(i, 7) != 2:
            w = [*brute.words(t), None]
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    ones, twos = (sum(c == k for c in bi.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos)
    kept = dict(bi)
    taken = Counter()
    for (a, _), c in kept.items():
        taken[a] += (c - discount) / uni[a]
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    for i, t in docs:
        w = [*brute.words(t), None]
        score = sum(math.log10((kept[a, b] - discount) / uni[a] * (1 if (a, b) in kept else 0) + (1 - taken[a]) * p1(b)) if (a, b) in kept
                    else math.log10((1 - taken[a]) * p1(b)) for a, b in zip([None, *w], w))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            brute.crc_mod(i, 7) == 2, len(w), sum(uni[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p1(x)) for x in w), abs=1e-6)
        assert r["score"] == pytest.approx(score, abs=3e-4 * len(w))
    # the mass of a context adds up to one: of the end, for example
    mass = sum((kept[None, b] - discount) / uni[None] for b in uni if (None, b) in kept) + (1 - taken[None])
    assert mass == pytest.approx(1)


@needs_tables
@pytest.mark.parametrize("name,label,mod,held,least", [("op7_quality", "quality", 3, 1, 0.97), ("op3_toxicity", "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, name, label, mod, held, least):
    labels = {r["doc_id"]: r[label] for r in table(spark, MIDDLE, "labels").collect()}
    found = [r for r in QUERIES[name](spark, MIDDLE).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(brute.crc_mod(r["doc_id"], mod) == held for r in found)
    for value in (0, 1):
        of = [r["predicted"] == value for r in found if labels[r["doc_id"]] == value]
        assert len(of) > 20 and np.mean(of) > least - 0.15
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in found]) > least


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 2**63), (1000, 1000), (5000, 2**64), (4096, 2**20)])
def test_elias_fano(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64, endpoint=universe == 0)) if n else np.zeros(0, np.uint64)
    path = tmp_path / "blob"
    path.write_bytes(b"junk" + pack({"a": np.arange(3)})[:30] + pack(prefixed("x", EliasFano.of(values)) | {"more": np.arange(5)}) + b"end")
    blobs = list(mapped(str(path)))
    assert len(blobs) == 1 and blobs[0]["more"].tolist() == [0, 1, 2, 3, 4]
    ef = coded("x", blobs[0])
    assert (ef.access(np.arange(n)) == values).all()
    ask = np.unique(np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)]))
    at, equal = ef.successor(ask)
    want = np.isin(ask, values)
    assert (equal == want).all() and (values[at[want]] == ask[want]).all()
    if n > 100:
        first, end = np.full(len(ask), 50), np.full(len(ask), 90)
        _, equal = ef.successor(ask, first, end)
        assert (equal == np.isin(ask, values[50:90])).all()


@needs_tables
@pytest.mark.parametrize("least", [1, 10**9])
def test_language_model_in_many_parts(spark, monkeypatch, least):
    """Small parts, contexts that lie in several, and chunks of a few texts give the same scores.

    So do scores that are known everywhere, be they of all pairs that occur again or of none.
    """
    whole = {r["doc_id"]: r for r in QUERIES["op2_language_model"](spark, SMALL).collect()}
    for name, value in {"PART_TOKENS": 500, "CONTEXT_TOKENS": 40, "TOGETHER": 20_000, "TALLIES": 3000, "FREQUENT": 1 << 60, "FREQUENT_LEAST": least}.items():
        monkeypatch.setattr(ngram_lm, name, value)
    found = QUERIES["op2_language_model"](spark, SMALL).collect()
    assert len(found) == len(whole)
    for r in found:
        w = whole[r["doc_id"]]
        assert tuple(r)[:5] == tuple(w)[:5]
        # the token before the first text of a chunk is an end in either case
        assert r["base_score"] == pytest.approx(w["base_score"]) and r["score"] == pytest.approx(w["score"], abs=3e-4 * w["n_tokens"])


def test_language_model_of_odd_rows(spark):
    """Repeated rows and null ids, training rows only, held-out rows only."""
    ids = [i for i in range(60) if brute.crc_mod(i, 7) != 2]
    held = [i for i in range(60) if brute.crc_mod(i, 7) == 2]
    text = "a b a b c"
    rows = [(ids[0], text), (ids[0], text), (None, text), (held[0], "a b x y"), (ids[1], "A  b\n"), (ids[2], None), (held[1], "")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(2)
    found = sorted(map(tuple, ngram_lm.language_scores(df).collect()), key=str)
    assert len(found) == len(rows) and len({r for r in found if r[0] == ids[0]}) == 1
    by_id = {r[0]: r for r in found}
    # 3 * 6 + 3 + 1 training tokens; a null id is the empty text, which is not held out
    assert by_id[None][1] is False and by_id[None][2:5] == (6, 6, 22) and by_id[None][6] == pytest.approx(by_id[ids[0]][6], abs=0.01)
    assert by_id[held[0]][1] is True and by_id[held[0]][2:4] == (5, 3)
    assert by_id[ids[2]][2] == by_id[held[1]][2] == 1
    only = ngram_lm.language_scores(spark.createDataFrame([(held[0], "a b")], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in only] == [(True, 3, 0, 0, 0.0, 0.0)]

"""Runs caught online against all periods of every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_edge_cases import LONG, ROWS, prose

from flipjoin.llm import square_runs
from flipjoin.llm.queries import QUERIES


def plain_runs(words, least=6, exponent=4):
    """Each period: maximal stretches that agree with those before; the smallest period of a stretch."""
    w, n, best = np.array(words), len(words), {}
    for q in range(1, n // exponent + 1):
        agree = np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(agree))
        for a, b in edge.reshape(-1, 2):
            if b - a + q >= max(least, exponent * q):
                best.setdefault((int(a), int(b - a + q)), q)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = set()
    for s, n, q in runs:
        gone |= set(range(s + q, s + n))
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rnd):
    """Few letters, planted repeats, repeats of repeats, and words without a square."""
    kind = rnd.randrange(6)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(rnd.randrange(300))]
    if kind == 1:
        return ["a"] * rnd.randrange(200)
    if kind == 2:
        t = ["a"]
        while len(t) < 250:
            t += ["b" if x == "a" else "a" for x in t]  # equal polynomial hashes, no cube
        return t
    out = []
    for _ in range(rnd.randrange(1, 5)):
        part = [rnd.choice("abcd"[:rnd.randrange(1, 5)]) for _ in range(rnd.randrange(1, 30))]
        if kind == 5:
            part = part * rnd.randrange(1, 6) + ["x"]
        part *= rnd.randrange(1, 9)
        out += part[:len(part) - rnd.randrange(4)]
    return out


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (9, 3), (2, 7)])
def test_runs_of_many_texts(least, exponent, monkeypatch):
    rnd = random.Random(exponent)
    texts = [random_words(rnd) for _ in range(250)] + [[], ["a"]]
    want = [plain_runs(t, least, exponent) for t in texts]
    assert sum(map(len, want)) > 200
    raw = [[w.encode() for w in t] for t in texts]
    assert square_runs.runs_of(raw, least, exponent) == want
    monkeypatch.setattr(square_runs, "STEP", 97)
    monkeypatch.setattr(square_runs, "COMPARED", 50)
    assert square_runs.runs_of(raw, least, exponent) == want
    for t, r in zip(texts, want):
        assert square_runs.kept_words(t, r) == plain_kept(t, r)


@pytest.mark.parametrize("step", [1, 2, 7, 64])
def test_words_appended_a_few_at_a_time(step):
    """Online: a run is reported with the word that ends it."""
    rnd = random.Random(step)
    for _ in range(40):
        words = [ord(c) for c in random_words(rnd)]
        catcher, found = square_runs.SquareCatcher(len(words)), []
        for i in range(0, len(words), step):
            ended = catcher.append(np.array(words[i:i + step], np.int64))
            assert all(i <= s + n < i + step for s, n, _ in ended)
            found += ended
        found += catcher.finish()
        assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(words)


def test_long_texts_take_little_time():
    """One word over and over, and a long period: no comparison is made twice."""
    assert square_runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    part = [b"%d" % i for i in range(40_000)]
    assert square_runs.runs_of([part * 5 + [b"z"], [b"z"]]) == [[(0, 200_000, 40_000)], []]


def with_repeats(doc_id, text):
    """The words of the contract."""
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = with_repeats(doc_id, text)
    runs = plain_runs(w) if w else []
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(listed.encode()), sha(b" ".join(plain_kept(w, runs))))


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_square_runs"](spark, folder).collect()]
    assert sorted(got) == sorted(plain_row(i, t) for i, t in docs)


def test_query_on_edge_cases(spark, tmp_path):
    rows = [r for r in ROWS if r[1] != LONG] + [(i, prose(i, 30) + " go" * (i % 40)) for i in range(100, 160)] + [(i, " ".join("ab" * i)) for i in range(20)]
    rows += [(i, t) for i in range(500, 560) for t in (None, "a", "é  \ta b é")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, w int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op12_square_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op12_square_runs"](spark, str(tmp_path / "none")).count() == 0

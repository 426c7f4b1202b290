"""Counts by merging arrays against the library, text by text."""

import random

import public_tokenizers
import pytest
import sentencepiece
from test_edge_cases import LONG, ROWS

from flipjoin.llm import token_counts
from flipjoin.llm.queries import QUERIES

PATH = public_tokenizers.path(token_counts.MODEL)


@pytest.fixture(scope="module")
def library():
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(ids) for ids in m.encode(texts, num_threads=1)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_model(PATH))


def test_odd_texts(counter, library):
    texts = ["", " ", "\t\n a", " a  b ", " " * 1000, " " * 33 + "\n" + " " * 17 + "x", "x" * 5000, "ab" * 3000, "0" * 99, "▁a▁▁b", "漢字仮名交じり文 " * 50,
             "<s>x</s> <unk><0x41>", "é ﬁ ①", "a\x00b", "﻿x​y", "\r\n\r\n  \r", "=" * 77, LONG]
    texts += [" " * k + end for k in range(80) for end in ("", "the", "\n", "é")]
    assert counter.count(texts) == library(texts)


def test_random_texts(counter, library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab e\n\t▁éтh漢0. ") for _ in range(rnd.randrange(90))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0xD7FF), rnd.randrange(0x10000, 0x10FFFF)])) for _ in range(60)) for _ in range(200)]
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [m.id_to_piece(i).replace("▁", " ") for i in range(259, m.get_piece_size())]
    texts += ["".join(rnd.choices(pieces, k=12)) for _ in range(1500)]  # pieces side by side merge anew
    assert counter.count(texts) == library(texts)


def test_memory_is_bounded(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    monkeypatch.setattr(token_counts, "SYMBOLS", 50)
    rnd = random.Random(4)
    for _ in range(5):
        texts = ["".join(rnd.choice("abc de") for _ in range(400)) for _ in range(20)] + ["y" * 999]
        assert counter.count(texts) == library(texts)
        assert all(len(t) <= token_counts.LONGEST_KEY for t in counter.known)


def test_other_vocabularies():
    """Equal scores, and a piece whose own pairs rank before it."""
    m = token_counts.merges([("a", -9), ("b", -9), ("▁", -9), ("ab", -3), ("abab", -1), ("aba", -2), ("bb", -4), ("aa", -4)])
    plain = lambda t: plain_count(m, t)
    rnd = random.Random(5)
    for _ in range(300):
        t = "".join(rnd.choice("aab") for _ in range(rnd.randrange(1, 40)))
        assert token_counts.merged_sizes(m, [t, "ba" + t])[0].tolist() == [plain(t), plain("ba" + t)]
    with pytest.raises(ValueError):
        token_counts.merges([("a", 0), ("▁", 0), ("a▁", 0)])


def plain_count(m, text):
    """One merge at a time: the lowest rank, then the leftmost."""
    pairs = {int(k): (int(m.rank[p]), int(p)) for k, p in zip(m.keys, m.piece)}
    sym, size = [m.symbols[c] for c in text], len(m.rank)
    while True:
        found = [(pairs[a * size + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a * size + b in pairs]
        if not found:
            return len(sym)
        (_, p), i = min(found, key=lambda x: (x[0][0], x[1]))
        sym[i:i + 2] = [p]


def test_rows(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, n_tokens string").repartition(3)
    out = token_counts.token_counts(df, limit=100)
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(ROWS, library([t or "" for _, t in ROWS]))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_query_on_all_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    got = QUERIES["op13_token_counts"](spark, folder).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) and r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in got)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from brute import crc_mod
import brute

from flipjoin.llm import (contamination, grace_dedup, line_dedup, ngram_lm, packing, quality_knn, simhash_golay,
                          suffix_dedup, toxicity_mil)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


LONG = prose(1, 60_000)
ROWS = [
    (1, prose(2, 80)), (2, prose(2, 80)), (2, prose(2, 80)), (3, prose(2, 80) + " end"), (None, prose(2, 80)),
    (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "One"), (9, LONG), (10, LONG[:200_000] + " changed"),
    (11, "x" * 5000), (12, "é<|endoftext|> 漢字  two  spaces\n\n\ttab"), (13, prose(3, 40) + "\n" + prose(2, 80)), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with those the operators add, and a partitioning that spreads rows."""
    df = spark.createDataFrame([(i, t, 1.0, "s") for i, t in ROWS], "doc_id long, text string, score double, kept string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score double, kept string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_suffix_dedup(docs, empty):
    out = suffix_dedup.remove_repeats(docs)
    got = out.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) n", "cast(size(removed) as long) s", "sha2(kept, 256) h")
    assert rows(got, "*") == sorted(brute.op1(ROWS), key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 20)


@pytest.mark.parametrize("length", [64, 300])
def test_suffix_dedup_lengths(docs, length):
    out = suffix_dedup.remove_repeats(docs, length).selectExpr("doc_id", "n_bytes - octet_length(kept) n")
    assert rows(out, "*") == sorted(((r[0], r[2]) for r in brute.op1(ROWS, length)), key=str)


def test_suffix_dedup_cuts_long_texts(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    out = suffix_dedup.remove_repeats(docs).selectExpr("doc_id", "n_bytes - octet_length(kept) n", "sha2(kept, 256) h")
    assert rows(out, "*") == sorted(((r[0], r[2], r[4]) for r in brute.op1(ROWS)), key=str)


def test_suffix_dedup_splits_a_gram_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 4)
    shared = prose(7, 30)[:230]
    texts = [(i, prose(100 + i, 20) + shared + prose(200 + i, 20)) for i in range(30)] + [(30, "x" + shared[:205])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) n", "cast(size(removed) as long) s", "sha2(kept, 256) h")
    assert rows(out, "*") == sorted(brute.op1(texts), key=str)


@pytest.mark.parametrize("length", [8, 20, 64, 65])
def test_windows_are_ordered_by_content(length):
    """Groups that hold different windows, as equal hashes would, fall apart byte by byte."""
    rng = np.random.default_rng(length)
    for letters in (2, 3):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        data[1000:1400] = data[200:600]
        data[2000:2300] = data[250:550]
        start = np.arange(len(data) - length + 1)
        for groups in (1, 5, 10**6):
            group = start * 0 if groups == 1 else (data[start] if groups == 5 else start)
            seen = {}
            for i, g in zip(start, group):
                seen.setdefault((int(g), data[i:i + length].tobytes()), []).append(i)
            want = np.zeros(len(start), bool)
            want[[i for same in seen.values() if len(same) > 1 for i in same]] = True
            assert (suffix_dedup.equal_windows(data, np.asarray(group, np.uint64), start, length) == want).all()
    assert not len(suffix_dedup.equal_windows(np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), length))


def test_language_model(docs, empty):
    out = {}
    for r in ngram_lm.language_scores(docs).collect():
        out.setdefault(r["doc_id"], r)
        assert r["score"] <= 0 and (r["doc_id"] is None or r["held_out"] == (crc_mod(r["doc_id"], 7) == 2))
    assert len(out) == len({i for i, _ in ROWS})
    assert out[5]["n_tokens"] == out[4]["n_tokens"] == out[6]["n_tokens"] == 1
    train = [t for i, t in ROWS if crc_mod("" if i is None else i, 7) != 2]
    assert out[1]["train_tokens"] == sum(len(brute.words(t)) + 1 for t in train)
    assert ngram_lm.language_scores(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (5, None, None), (99, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for known in (labels, none):
        out = toxicity_mil.toxicity_scores(docs, known)
        assert out.columns == ["doc_id", "text", "kept", "held_out", "score", "predicted", "offending"]
        found = out.collect()
        assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
        assert {r["score"] for r in found if not (r["text"] or "").strip()} == {0.0}
    assert toxicity_mil.toxicity_scores(empty, labels).count() == 0


def test_toxic_sentence_is_located(spark):
    rows_ = [(i, f"{prose(i, 12)}. {prose(i + 500, 9)} {'badword' if i % 2 else 'fine'}! {prose(i + 900, 12)}.") for i in range(300)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows_], "doc_id long, quality int, toxic int")
    out = toxicity_mil.toxicity_scores(df, labels).filter("held_out").collect()
    for r in out:
        assert r["predicted"] == r["doc_id"] % 2
        assert all("badword" in r["text"][s["start"]:s["end"]] for s in r["offending"]) and len(r["offending"]) == r["predicted"]


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        found = quality_knn.quality_scores(docs, known).collect()
        assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
        by_text = {}
        for r in found:
            by_text.setdefault(r["text"] or "", set()).add(round(r["score"], 6))
        assert all(len(s) == 1 for s in by_text.values())
    assert quality_knn.quality_scores(empty, labels).count() == 0


def test_contamination(spark, docs, empty):
    items = [(1, prose(2, 80)), (2, prose(2, 80).upper()), (3, "one"), (4, ""), (5, None), (6, "never seen at all"), (7, LONG[:3000])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(contamination.contamination(docs, bench), "doc_id", "n_items", "item_id", "contaminated")
    assert got == sorted(brute.op4(ROWS, items), key=str)
    assert contamination.contamination(empty, bench).count() == 0
    assert contamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_contamination_of_short_items(spark):
    """Items of one to four words inside longer texts, next to items of all sizes."""
    rng = np.random.default_rng(4)
    items = [(i, " ".join(WORDS[j] for j in rng.integers(0, len(WORDS), 1 + i % 9))) for i in range(60)] + [(90 + i, prose(60 + i, 40 * i + 5)) for i in range(6)]
    texts = [(i, prose(200 + i, int(rng.integers(0, 60)))) for i in range(150)] + [(500 + i, prose(3, 9) + " " + items[60 + i % 6][1]) for i in range(12)]
    texts += [(600, "alpha"), (601, "Beta gamma"), (602, items[7][1])]
    got = contamination.contamination(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_items", "item_id", "contaminated") == sorted(brute.op4(texts, items), key=str)
    only_long = items[60:]
    got = contamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(only_long, "item_id long, text string"))
    assert rows(got, "doc_id", "n_items", "item_id", "contaminated") == sorted(brute.op4(texts, only_long), key=str)


@pytest.mark.parametrize("n", [0, 1, 5000, 10**9])
def test_filters_are_sized_from_counts(n):
    assert contamination.LEAST_BITS <= contamination.filter_bits(n) <= contamination.MOST_BITS
    assert n > 10**8 or 2 ** contamination.filter_bits(n) >= 16 * n


def test_packing(docs, empty):
    out = packing.pack(docs, group_pieces=5).collect()
    encode = packing.encoder()
    assert sum(r["length"] for r in out) == sum(len(encode.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 9)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == packing.CAPACITY for _, _, n in long[1:])
    assert packing.pack(empty).count() == 0


def test_token_ids_are_the_tokenizers(spark):
    encode = packing.encoder()
    texts = [prose(i, 60) for i in range(20)] + [t for _, t in ROWS if t and len(t) < 6000] + \
        ["It's we'll\nI'd x1y2 3.14 -- (a)\nÜber straße “q” end", " lead", "trail ", "a\tb", "a b", "a b", "a \n b", "’s don’t", "a\x00b"]
    for t in texts:
        want = np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()
        assert encode(t) == want, t


@pytest.mark.parametrize("limit", [1, 400, grace_dedup.TABLE_BYTES])
def test_exact_dedup(docs, empty, limit):
    out = grace_dedup.exact_duplicates(docs, limit)
    assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.op6(ROWS), key=str)
    assert sorted(out.columns) == sorted(["doc_id", "text", "score", "keep_id", "group_size", "kept", "text_sha256"])
    stay = grace_dedup.without_copies(docs, limit)
    assert stay.columns == docs.columns and stay.count() == sum(r[3] for r in brute.op6(ROWS))
    assert grace_dedup.exact_duplicates(empty).count() == 0


def test_simhash(docs, empty):
    from pyspark.sql import functions as F

    out = simhash_golay.near_duplicates(docs).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    assert rows(out, "doc_id", "f", "component_id") == sorted(brute.op8(ROWS), key=str)
    assert simhash_golay.near_duplicates(empty).count() == 0
    stay = simhash_golay.without_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.collect()} == {r[2] for r in brute.op8(ROWS)}


def test_simhash_links_survive_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash_golay, "GROUP", 8)
    rng = np.random.default_rng(5)
    fps = [int(rng.integers(0, 2**63))]
    for _ in range(120):  # a chain of steps of one or two bits, and lone ones
        f = fps[int(rng.integers(0, len(fps)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 3))):
            f ^= 1 << int(b)
        fps.append(f)
    fps += [int(x) for x in rng.integers(0, 2**63, 50)]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash_golay.links(df).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2
        parent[root(r["a"])] = root(r["b"])
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert root(a) == root(b)


LINE_COLUMNS = ("doc_id", "n_units", "n_removed", "array_join(transform(removed, r -> concat(r.start, '-', r.end)), ' ') s",
                "longest_removed", "longest_shared", "sha2(kept_text, 256) h")


def test_line_dedup(spark, empty):
    line = "A line that is long enough to be looked at, surely."
    passage = "One sentence of it. Another one, a little longer than that!  And is this the third? It is. So the passage ends, after all it had to say."
    broken = passage.replace("that!  And", "that!\nAnd").replace("It is. So", "It is.\n\nSo")
    data = [(1, f"{line}\nother\n{line}  \n"), (2, None), (3, line.upper()), (4, "short\nshort\n 3.14. x"), (5, f"\n{line}\n{prose(1, 20)}"), (6, ""),
            (7, f"Before it. {passage} After it.\nIt is."), (8, f"Something else. {broken} Then more."), (9, f"{passage}\nIt is. Really it is."), (10, " \n\n é. É. "),
            (11, LONG[:20_000]), (12, LONG[:9000] + ". " + passage)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, removed string").repartition(3)
    out = line_dedup.without_repeated_units(df)
    assert out.columns == ["doc_id", "text", "n_units", "n_removed", "removed", "longest_removed", "longest_shared", "kept_text"]
    assert rows(out.selectExpr(*LINE_COLUMNS), "*") == sorted(brute.op9(data), key=str)
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[8]["n_removed"] >= 2 and found[7]["n_removed"] == 1 and found[7]["longest_shared"] > 100
    assert found[9]["kept_text"] == "Really it is."
    assert line_dedup.without_repeated_units(empty).count() == 0
    paragraphs = spark.createDataFrame([(1, f"{line}\n\n{line}")], "doc_id long, text string")
    r = line_dedup.without_repeated_units(paragraphs, "paragraph").collect()[0]
    assert r["kept_text"] == line and r["removed"][0]["start"] == len(line) + 2


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    """Of rows alike one is the earliest; a null id comes last."""
    text = "Some line of text.\nAnd another one."
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "Some line of text."), (1, text)], "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"] or 99, r["n_removed"], r["kept_text"]) for r in line_dedup.without_repeated_units(df).collect()))
    assert got == [(1, 0, text), (1, 2, ""), (1, 2, ""), (99, 1, ""), (99, 2, "")]


def test_line_dedup_of_random_texts(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(WORDS[i] for i in rng.integers(0, len(WORDS), rng.integers(1, 12))) + str(rng.choice([".", "!", "?", "", ".."])) for _ in range(60)]
    data = [(i, "".join(pool[j] + str(rng.choice([" ", "\n", "  \t", "\n\n", " "])) for j in rng.integers(0, 60, rng.integers(1, 12)))) for i in range(120)]
    for min_run in (1, 60, 120):
        out = line_dedup.without_repeated_units(spark.createDataFrame(data, "doc_id long, text string"), min_run=min_run)
        assert rows(out.selectExpr(*LINE_COLUMNS), "*") == sorted(brute.op9(data, min_run), key=str)

"""The pipeline and its stages against plain versions, on the smallest tables."""

import os
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flipjoin.llm import packing, quality_knn
from flipjoin.llm.common import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


def plain_quality(space, text):
    """Neighbours one by one."""
    x = space.project(quality_knn.term_counts([text.encode()]))[0]
    near = sorted(((float(np.dot(x, v)), y) for v, y in zip(space.vectors, space.labels)), reverse=True)[:quality_knn.NEIGHBOURS]
    weights = [np.exp(quality_knn.SHARPNESS * (c - 1)) for c, _ in near]
    return sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)


def test_run_against_plain_stages(spark):
    docs = table(spark, SMALL, "documents")
    space = quality_knn.learn(docs, table(spark, SMALL, "labels"))
    left = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sizes = [len(left)]
    left = [(i, t) for i, t in left if plain_quality(space, t) >= 0.5]
    sizes.append(len(left))
    kept = {r[0] for r in brute.op6(left) if r[3]}
    left = [(i, t) for i, t in left if i in kept]
    sizes.append(len(left))
    kept = {r[2] for r in brute.op8(left)}
    left = [(i, t) for i, t in left if i in kept]
    sizes.append(len(left))
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.op4(left, items) if r[3]}
    left = [(i, t) for i, t in left if i not in bad]
    sizes.append(len(left))
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] > sizes[4] > 50  # every kind of decision occurs

    tokenizer = packing.encoder().tokenizer
    want = set()
    for i, t in left:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], np.uint32)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1]) and sum(n for _, n in pieces) <= 1024
    total = sum(n for *_, n, _ in want)
    assert len(filled) <= 1.03 * total / 1024 + 1


def test_stages_keep_the_columns(spark):
    """Names and values, where every name that an operator adds is taken."""
    taken = ["score", "predicted", "held_out", "keep_id", "group_size", "kept", "text_sha256", "component_id", "n_items", "item_id", "contaminated"]
    docs = table(spark, SMALL, "documents").limit(40)
    for k, name in enumerate(taken):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), "doc_id"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r == rows[r["doc_id"]] for r in found)
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_without_labels_and_items_every_clean_row_stays(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(20)
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, str(tmp_path)).count() == 20


def test_near_duplicates_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "A b  c"), (3, "a b c"), (None, None), (None, ""), (None, None)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(str(r["doc_id"]) for r in stage(spark, df, "").collect()) == ["3", "None"]


def test_packing_is_close_to_the_least(spark):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1024, 3000), np.minimum(1023, rng.lognormal(5.5, 0.9, 3000).astype(int) + 1)):
        sequence, offset = packing.pack_lengths(lengths)
        ends = defaultdict(int)
        for s, o, n in sorted(zip(sequence, offset, lengths)):
            assert ends[s] == o
            ends[s] += n
        assert max(ends.values()) <= 1024 and len(ends) <= 1.02 * lengths.sum() / 1024 + 1

"""The trie and its totals against a plain one that walks every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flipjoin.llm import prefix_trie
from flipjoin.llm.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string, n_children string, part int"


def plain(rows, family=20, shared=4):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    members, last = defaultdict(list), {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        seq = (*own.get(c - c % family, [])[:h], *t[h:])
        last[c] = seq
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = lambda q: sum(1 for x in members if len(x) == len(q) + 1 and x[:len(q)] == q)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in ids if last[c] == p)))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids(p), sum(not kids(q) for q in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], CONVERSATIONS).repartition(3)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def some_conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 3 * n), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "a b", "A  b\tc\n", None, "", " "])))
    return rows + rnd.sample(rows, 3) + [(None, 1, "user", "nobody's"), (7, 5, "user", "w " * 500)]


@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 3)])
def test_random_conversations(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = some_conversations(seed, 60)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert result(prefix_trie.conversation_trie(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_query_on_edge_cases(spark, tmp_path):
    """A long conversation among copies, turnless ones, and ones of whom the base is absent."""
    rows = [(20, t, "user", f"t{t % 5}") for t in range(120)] + [(c, t, "user", f"t{t % 5}") for c in (21, 22, 23, 24, 25, 26) for t in range(c * 3)]
    rows += [(c, 0, None, None) for c in range(100, 130)] + [(1001, 0, "a", "b"), (1002, 0, "a", "b"), (-3, 0, "a", "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert result(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == plain(rows)
    frame(spark, rows).limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path / "none")).count() == 0
    nobody = prefix_trie.conversation_trie(frame(spark, [(None, 1, "user", "x")]))
    assert nobody.count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_contraction(spark, shape):
    """Sums over subtrees, and few rounds for any shape."""
    rnd = random.Random(shape)
    n = 600
    above = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i), "comb": lambda i: i - 1 if i % 2 else max(i - 2, 0)}[shape]
    parent = [None] + [above(i) for i in range(1, n)]
    weight = [rnd.randrange(1000) for _ in range(n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    df = spark.createDataFrame([(i, depth[i], p, None if p is None else depth[p], w) for i, (p, w) in enumerate(zip(parent, weight))],
                               "i long, d long, p long, pd long, w long")
    id_ = F.struct(F.col("i").alias("conv_id"), F.col("d").alias("depth"))
    up = F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("conv_id"), F.col("pd").alias("depth")))
    rounds = []
    kept = prefix_trie.stored
    prefix_trie.stored = lambda df, name: (rounds.append(name), kept(df, name))[1]
    try:
        got = {r["id"]["conv_id"]: (r["n_children"], r["n_leaves"], r["w"])
               for r in prefix_trie.contracted(df.select(id_.alias("id"), up.alias("parent"), "w"), ["n_leaves", "w"]).collect()}
    finally:
        prefix_trie.stored = kept
    kids, total, leaves = [0] * n, list(weight), [0] * n
    for i in reversed(range(n)):
        leaves[i] = leaves[i] or 1
        if i:
            kids[parent[i]] += 1
            total[parent[i]] += total[i]
            leaves[parent[i]] += leaves[i]
    assert got == {i: (kids[i], leaves[i], total[i]) for i in range(n)}
    assert rounds.count("raked") <= {"star": 2}.get(shape, 14)


def test_running_over_parts(spark):
    """A key with most rows lies in several parts, and is numbered through."""
    df = spark.createDataFrame([(k, i) for k, n in ((1, 3), (2, 500), (3, 40), (4, 1)) for i in range(n)], "conv_id long, i long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix_trie.stored(prefix_trie.ordered(df.repartition(5), "conv_id", [F.col("i")]), "placed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.filter("conv_id = 2").select("part").distinct().count() > 1
    out = prefix_trie.running(placed, "conv_id", {"pos": F.lit(1).cast("long")}, {"x": F.col("i")}).collect()
    assert len(out) == 544
    for r in out:
        x = 0
        for i in range(r["i"] + 1):
            x ^= i
        assert r["pos"] == r["i"] + 1 and r["x"] == x

"""Totals over the prefix trie of conversations by parallel tree contraction.

A node is a sequence of turns with which at least one conversation begins.  Its name is
a hash of that sequence: every turn is hashed with its place, and a running XOR over the
turns of a conversation gives the name of each prefix, and of its parent.

Subtree totals need no walk from level to level.  A round of joins *rakes* all leaves
into their parents and then *compresses* unary chains: of three neighbours in a chain
one is taken out, and its child hangs on its parent and carries its weight.  Depth does
not count, so a conversation of many turns takes as few rounds as a bushy trie: each
takes a fixed share of the nodes.  The rounds are then undone backwards: the total of a
node that was taken out is that of its child, plus what its child carried for it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Ids of one row when the members of a node are hashed.
IDS = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NAME = ("n1", "n2", "depth")


def ordered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` sorted by ``key`` and ``order``, with part and line: where each row stands.

    Dealt by range, so the rows of one key may lie in several tasks; equal rows are
    alike, so a task that is run again numbers them as before.
    """
    parted = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    at = F.monotonically_increasing_id()  # part and line in one number
    return parted.withColumn("at", at).withColumns({
        "part": F.shiftright("at", 33), "line": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")


def running(placed: DataFrame, key: str, sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Running sums and XORs over the rows of each key, in the order of ``ordered``.

    Rows of one key inside one part are taken by a window; what the earlier parts hold of
    a key that lies in several of them is added by a join with one row a part and such key.
    """
    inside = Window.partitionBy(key, "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    both = [*sums, *xors]
    here = placed.withColumns({c: F.sum(e).over(inside) for c, e in sums.items()} | {c: F.bit_xor(e).over(inside) for c, e in xors.items()})
    whole = placed.groupBy(key, "part").agg(*[F.sum(e).alias(c) for c, e in sums.items()], *[F.bit_xor(e).alias(c) for c, e in xors.items()])
    parts = whole.groupBy(key).agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").drop("first", "last")
    wide = whole.join(parts, key)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    carried = wide.select(key, "part", *[F.sum(c).over(before).alias(f"_{c}") for c in sums], *[F.bit_xor(c).over(before).alias(f"_{c}") for c in xors])
    out = here.join(carried, [key, "part"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: (F.col(c) + F.coalesce(f"_{c}", zero)) if c in sums else F.col(c).bitwiseXOR(F.coalesce(f"_{c}", zero)) for c in both}
                           ).drop(*[f"_{c}" for c in both], "part", "line")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (a 128-bit hash of role and text) and words.

    Turns are ordered by turn (null first), then role and text.  Rows without a conv_id
    belong to no conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda k: F.conv(F.substring(content, k, 15), 16, 10).cast("long")
    # the text goes no further than this sort
    placed = ordered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select(
        "conv_id", "part", "line", half(1).alias("t1"), half(17).alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return running(stored(placed, "turns"), "conv_id", {"pos": F.lit(1).cast("long")}, {})


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, t1, t2, words) and lengths (conv_id, n) of rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % ``family`` (all
    if it has fewer, none if there is none), h being crc32(decimal c) % ``shared``, and
    goes on with its own turns after its first h.
    """
    turns = stored(numbered_turns(conversations), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads = turns.filter((F.col("pos") < shared) & (F.pmod("conv_id", F.lit(family)) == 0))
    starts = lengths.filter(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("held"))
    convs = lengths.withColumns({
        "base": F.col("conv_id") - F.pmod("conv_id", F.lit(family)),
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("long"),
    }).join(starts, "base", "left").withColumn("lent", F.least("h", F.coalesce("held", F.lit(0).cast("long"))))
    convs = stored(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").filter("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("lent"))
    # at most shared - 1 turns, to at most ``family`` conversations
    lent = convs.filter("lent > 0").select("conv_id", "base", "lent").join(heads.withColumnRenamed("conv_id", "base"), "base").filter(
        "pos <= lent").withColumnRenamed("pos", "depth")
    fields = ["conv_id", "depth", "t1", "t2", "words"]
    return own.select(*fields).unionByName(lent.select(*fields)), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the name of each prefix (n1, n2, depth) and of its parent (p1, p2)."""
    placed = ordered(turns, "conv_id", [F.col("depth")])
    salted = {f"s{k}": F.xxhash64(F.lit(k), "depth", "t1", "t2") for k in (1, 2)}
    placed = stored(placed.withColumns(salted).drop("t1", "t2"), "prefixes")
    named = running(placed, "conv_id", {}, {"n1": F.col("s1"), "n2": F.col("s2")})
    return named.withColumns({"p1": F.col("n1").bitwiseXOR(F.col("s1")), "p2": F.col("n2").bitwiseXOR(F.col("s2"))}).drop("s1", "s2")


def member_digests(ends: DataFrame) -> DataFrame:
    """The name of each node in ``ends`` (name, conv_id) and the SHA-256 of its ids.

    The ids, ascending and joined by commas, are read in order: dealt by range, tasks join
    up to IDS of one node to a text; then each node's texts, few for one node, are sorted
    and hashed as they pass.  No list of ids is held.
    """
    name = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("depth", pa.int64())])
    text_schema = name.append(pa.field("first", pa.int64())).append(pa.field("ids", pa.string()))
    sha_schema = name.append(pa.field("ends_sha256", pa.string()))

    def batch_of(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def join_ids(batches):
        node, ids, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*NAME, "conv_id")]
            for a, b, d, conv_id in zip(*columns):
                if ids and (node != (a, b, d) or len(ids) == IDS):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = (a, b, d)
                ids.append(conv_id)
            if out:
                yield batch_of(out, text_schema)
                out = []
        if ids:
            yield batch_of([(*node, ids[0], ",".join(map(str, ids)))], text_schema)

    def hash_ids(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for a, b, d, ids in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")]):
                if node == (a, b, d):
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b, d), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield batch_of(out, sha_schema)
                out = []
        if node is not None:
            yield batch_of([(*node, sha.hexdigest())], sha_schema)

    fields = "n1 long, n2 long, depth long"
    sorted_ids = ends.select(*NAME, "conv_id").repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    texts = sorted_ids.mapInArrow(join_ids, f"{fields}, first long, ids string")
    return texts.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(hash_ids, f"{fields}, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: id (its smallest member and depth), parent, n_convs, words, ends_sha256."""
    zero = F.lit(0).cast("long")
    named = stored(prefixes(turns), "prefixes")
    nodes = named.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
                                     F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in NAME], "conv_id", "n_convs", *[zero.alias(c) for c in ("words", "p1", "p2")])
    nodes = stored(nodes.select(*root.columns).unionByName(root), "nodes")
    last = named.select(*NAME, "conv_id").join(lengths.filter("n > 0").select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi")
    ends = last.select(*NAME, "conv_id").unionByName(lengths.filter("n = 0").select(*[zero.alias(c) for c in NAME], "conv_id"))
    above = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(above, ["p1", "p2", "depth"], "left").join(member_digests(ends), list(NAME), "left")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    return found.select(F.struct("conv_id", "depth").alias("id"), parent.alias("parent"), "n_convs", "words",
                        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def sooner(a: Column, b: Column, turn: int) -> Column:
    """Whether node ``a`` is taken out before ``b``: by one bit of the depth, then by hash.

    In a chain of even steps every second node has the bit of the round, so half of it goes.
    """
    def key(x: Column) -> Column:
        bit = F.shiftright(x["depth"], min(turn, 62)).bitwiseAND(F.lit(1).cast("long"))
        return F.struct((-bit).alias("bit"), F.xxhash64(x, F.lit(turn)).alias("h"), x.alias("x"))

    return key(a) < key(b)


def contracted(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """id, n_children and for each of ``weights`` its sum over the subtree of the node.

    ``nodes`` has id, parent (null at roots) and the weights.  Three kinds of tables are
    stored each round: the totals of raked leaves, the nodes that were taken out of
    chains, each with its child and what that carried, and the smaller tree.  What a
    node of many children gets from its leaves is summed before it is shuffled.  Hot
    parents are split by adaptive execution, as each has one row on the other side.
    """
    carried = [f"c_{w}" for w in weights]
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    full = nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaves = [F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_leaves")] if "n_leaves" in weights else []
    own = [w for w in weights if w != "n_leaves"]
    start = stored(full.select("id", "parent", "n_children", *own, *leaves), "tree")
    tree = start.select("id", "parent", "n_children", *weights, *[F.lit(0).cast("long").alias(c) for c in carried])
    totals, removed, held = [], [], []
    turn = 0
    while not tree.isEmpty():
        leaf = F.col("n_children") == 0
        done = stored(tree.filter(leaf).select("id", *weights), "totals")
        totals.append(done)
        # every child tells its parent: a leaf what it weighs, any other that it is there
        sent = [F.sum(F.when(leaf, F.col(w) + F.col(c)).otherwise(0)).alias(f"got_{w}") for w, c in zip(weights, carried)]
        told = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *sent, F.sum(F.when(leaf, 0).otherwise(1)).cast("long").alias("left"), F.min(F.when(~leaf, F.col("id"))).alias("only"))
        raked = tree.filter(~leaf).join(told, "id").select(
            "id", "parent", F.col("left").alias("n_children"), *[(F.col(w) + F.col(f"got_{w}")).alias(w) for w in weights], *carried,
            F.when(F.col("left") == 1, F.col("only")).alias("only"))
        inner = F.col("only").isNotNull() & F.col("parent").isNotNull()
        local = inner & sooner(F.col("id"), F.col("parent"), turn) & sooner(F.col("id"), F.col("only"), turn)
        raked = stored(raked.withColumn("out", F.coalesce(local, F.lit(False))), "raked")
        gone = raked.filter("out").select(F.col("only").alias("id"), F.col("id").alias("node"), F.col("parent").alias("above"),
                                          *[F.col(w).alias(f"w_{w}") for w in weights], *[F.col(c).alias(f"a_{c}") for c in carried])
        joined = stored(raked.filter("not out").drop("only", "out").join(gone, "id", "left"), "compressed")
        removed.append(joined.filter("node IS NOT NULL").select(F.col("id").alias("child"), F.col("node").alias("id"), *[
            (F.col(f"w_{w}") + F.col(c)).alias(f"plus_{w}") for w, c in zip(weights, carried)]))
        held.append(joined)
        discard(raked)
        tree = joined.select("id", F.when(F.col("node").isNotNull(), F.col("above")).otherwise(F.col("parent")).alias("parent"), "n_children", *weights, *[
            (F.col(c) + F.coalesce(F.col(f"w_{w}") + F.col(f"a_{c}"), F.lit(0).cast("long"))).alias(c) for w, c in zip(weights, carried)])
        turn += 1
    for out in reversed(removed):
        known = totals[0]
        for more in totals[1:]:
            known = known.unionByName(more)
        again = out.join(known.select(F.col("id").alias("child"), *weights), "child").select(
            "id", *[(F.col(w) + F.col(f"plus_{w}")).alias(w) for w in weights])
        totals.append(stored(again, "totals"))
    if not totals:
        return start.select("id", "n_children", *weights)
    known = totals[0]
    for more in totals[1:]:
        known = known.unionByName(more)
    out = stored(start.select("id", "n_children").join(known, "id"), "trie")
    discard(start, *totals, *held)
    return out


def prefix_totals(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns``, with the totals of its subtree.

    ``turns`` has conv_id, depth (1 to n without a gap), t1, t2 (a hash of the turn) and
    words; ``lengths`` has conv_id and n, also of conversations without a turn.  Columns:
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    nodes = stored(trie(turns, lengths), "nodes")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    totals = contracted(nodes.select("id", "parent", saved), ["n_leaves", "saved_tokens"])
    return nodes.join(totals, "id").select(
        "id.conv_id", "id.depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """The prefix trie of the rebuilt conversations; see ``rebuilt`` and ``prefix_totals``.

    Null roles and texts are empty, a null turn comes first, equal turns are ordered by
    role and text, and repeated rows are turns of their own.  Rows without a conv_id are
    left out; no other column is read.  A conversation that is left without turns is a
    member of the root alone.  An empty table has no root and gives an empty result.
    """
    return prefix_totals(*rebuilt(conversations, family, shared))

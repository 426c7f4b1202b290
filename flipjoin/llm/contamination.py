"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least four fifths of its different
five-word shingles occur there; an item of fewer words is one shingle of its own width,
and is contained where its words stand side by side.  Items are partitioned by the power
of two below their number q of shingles.  The size decides how many MinHash minima an
item needs: of its q shingles at most ``q - need`` may be missing, so one of its ``q -
need + 1`` smallest by hash must occur in the document, however long that is.  A
document is searched in the partitions whose items it is large enough for, and only if
it hits a minimum there; its shingles that occur in any item are then joined with the
items, and counted exactly.  So no contained item is missed, and none is reported that
is not.

The tests in front of the join are Bloom filters, one of minima for each partition and
one of all shingles, sized from their counts up to a bound: what is broadcast has a
largest size, and a filter that lets too much through costs time, not correctness.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only_text, row_key, stored, text_bytes
from .numhash import Words, text_groups

WIDTH, THRESHOLD = 5, 0.8
#: A filter has about this many bits for each hash, 2^16 at least and 2^27 (16 MB) at most.
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 16, 27
#: The number of the filter of all shingles.
ALL = -1


def needed(q, threshold: float = THRESHOLD):
    """Shingles of an item of size q that must occur: the ceiling, exact in binary."""
    return F.ceil(q * F.lit(round(threshold * 1000)) / 1000).cast("long")


def _shingles(width: int, key: str):
    """(key, width, hash) for the different shingles of each item; a shorter text is one of its own width."""
    schema = pa.schema([(key, pa.int64()), ("width", pa.int32()), ("hash", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            keys = np.asarray(batch.column(key).to_numpy(zero_copy_only=False))
            for a, b in text_groups(texts, 4 << 20):
                words = Words(texts[a:b])
                sizes = np.diff(words.first)
                for w in range(1, width + 1):
                    h, t = full_shingles(words, w)
                    mine = (sizes[t] >= width) if w == width else (sizes[t] == w)
                    h, t = _different(h[mine], t[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][t]), pa.array(np.full(len(h), w, np.int32)), pa.array(h.view(np.int64))], schema=schema)

    return run


def full_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``width`` words; shorter texts have none."""
    h, t = words.shingles(width)
    n = np.diff(words.first)
    runs = int(np.maximum(n - width + 1, 0).sum())  # the runs of shorter texts come behind
    return h[:runs], t[:runs]


def _different(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a text once."""
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def _found(widths: list[int], minima: dict[int, np.ndarray], members: np.ndarray, threshold: float):
    """(row_key, hash) for documents that hit a minimum of a partition: their shingles that items have."""
    schema = pa.schema([("row_key", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            keys = np.asarray(batch.column("row_key").to_numpy(zero_copy_only=False))
            for a, b in text_groups(texts, 4 << 20):
                words = Words(texts[a:b])
                parts = [full_shingles(words, w) for w in widths]
                h, t = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                size = np.bincount(t, minlength=b - a)  # repeats included: not less than the different ones
                member = in_filter(members, h)
                h, t = h[member], t[member]
                hit = np.zeros(b - a, bool)
                for part, words_of in minima.items():
                    fits = size[t] >= int(threshold * 1000) * (1 << part) // 1000
                    hit[t[fits][in_filter(words_of, h[fits])]] = True
                h, t = _different(h[hit[t]], t[hit[t]])
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][t]), pa.array(h.view(np.int64))], schema=schema)

    return run


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for slot in _slots(h, (len(words) * 64).bit_length() - 1):
        out &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


def filter_bits(n: int) -> int:
    """log2 of the bits of a filter of ``n`` hashes."""
    return min(max((n * BITS_PER_HASH).bit_length(), LEAST_BITS), MOST_BITS)


def blooms(hashes: DataFrame, bits: dict[int, int]) -> dict[int, np.ndarray]:
    """A filter over ``hash`` for each ``part``, of 2^bits[part] bits: at most that many / 64 words come back."""
    width = F.element_at(F.create_map(*[F.lit(x) for item in bits.items() for x in item]), F.col("part"))
    masked = hashes.select("part", "hash", width.alias("bits")).select("part", "hash", F.expr("shiftleft(1L, bits) - 1").alias("mask"))
    slot = F.explode(F.array(F.col("hash").bitwiseAND(F.col("mask")), F.shiftrightunsigned("hash", 32).bitwiseAND(F.col("mask"))))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = masked.select("part", slot.alias("slot")).groupBy("part", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    part, word, found = (rows.column(c).to_numpy() for c in ("part", "word", "bits"))
    out = {}
    for p, n in bits.items():
        words = np.zeros(1 << (n - 6), np.int64)
        words[word[part == p]] = found[part == p]
        out[p] = words.view(np.uint64)
    return out


def item_shingles(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item, width, hash, q, need, whether the shingle is one of the item's minima, and its partition.

    Items with the same set of shingles are one, named by the smallest id; an item
    without words has no shingle and is contained nowhere.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = rows.groupBy("text").agg(F.min("item").alias("item"))
    shingles = one.mapInArrow(_shingles(width, "item"), "item long, width int, hash long")
    sets = shingles.groupBy("item").agg(F.count("*").alias("q"), F.sum(F.xxhash64("hash").cast("decimal(20,0)")).alias("sum"))
    chosen = sets.groupBy("q", "sum").agg(F.min("item").alias("item")).select("item", "q")
    joined = shingles.join(chosen, "item").withColumn("need", needed(F.col("q"), threshold))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash"))  # of one item
    return joined.withColumns({"minimum": rank <= F.col("q") - F.col("need") + 1, "part": F.floor(F.log2("q")).cast("int")})


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """row_key, item, shared, q: the items that each document contains."""
    known = stored(item_shingles(items, width, threshold), "item-shingles")
    spark: SparkSession = docs.sparkSession
    # one row a width and partition: few, whatever the items
    sizes = known.groupBy("width", "part").agg(F.count("*").alias("n"), F.count_if("minimum").alias("minima")).collect()
    bits = {part: filter_bits(sum(r["minima"] for r in sizes if r["part"] == part)) for part in {r["part"] for r in sizes}}
    bits[ALL] = filter_bits(sum(r["n"] for r in sizes))
    hashes = known.filter("minimum").select("part", "hash").unionByName(known.select(F.lit(ALL).alias("part"), "hash"))
    minima = blooms(hashes, bits)
    members = minima.pop(ALL)
    widths = sorted({r["width"] for r in sizes})
    wide = spark.sparkContext.broadcast((minima, members))

    def run(batches):
        yield from _found(widths, *wide.value, threshold)(batches)

    found = only_text(docs).select(row_key().alias("row_key"), "text").mapInArrow(run, "row_key long, hash long").distinct()
    counted = found.join(known.select("item", "hash", "q", "need"), "hash").groupBy("row_key", "item").agg(
        F.count("*").alias("shared"), F.first("q").alias("q"), F.first("need").alias("need"))
    return counted.filter(F.col("shared") >= F.col("need")).drop("need")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with n_items, item_id (the smallest) and contaminated.

    Words are runs without white space, A-Z in lower case.  An item of fewer words than
    ``width`` is one shingle of its own width, an empty or null one has none.  Items with equal sets of
    shingles count once.  Rows that repeat an id and a text get the same result.  With
    no items, no document is contaminated; an empty table gives an empty result.
    Columns of ``docs`` with one of the three names are replaced.
    """
    found = contained_items(docs, items, width, threshold).groupBy(F.col("row_key").alias("__key")).agg(
        F.count("*").alias("n_items"), F.min("item").alias("item_id"))
    clean = docs.drop("n_items", "item_id", "contaminated")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = clean.withColumn("__key", F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))))
    out = keyed.join(found, "__key", "left").drop("__key")
    return out.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long"))).withColumn("contaminated", F.col("n_items") > 0)

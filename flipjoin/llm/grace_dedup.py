"""Exact deduplication by Grace hashing.

Every task feeds its records into a Grace table: records go into an in-memory
open-addressing table (Python's dict, which compares complete keys) until a byte
budget is reached, then to spill files by four bits of their hash, and each file is
worked off the same way with the next four bits, until a bucket fits.  Spill files belong to
one task, in its own temporary folder, and go with it; no other task reads them.  The first
pass runs where documents are read, so copies melt before anything is shuffled and
a group of copies that holds a third of all rows reaches the second pass as one
record a task.  The second pass runs after a shuffle on the hash.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, only_text, text_bytes

#: Bytes of content that one in-memory table may hold.
TABLE_BYTES = 48 << 20
FAN_OUT_BITS = 4

Entry = tuple[int, int | None, int]  # code points and id of the best row, rows


def better(a: Entry, b: Entry) -> Entry:
    """The longer original, then the smaller id (null last); rows add up."""
    key = lambda e: (-e[0], e[1] is None, e[1] or 0)
    best = a if key(a) <= key(b) else b
    return best[0], best[1], a[2] + b[2]


def grace(records: Iterable[tuple[bytes, Entry]], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[bytes, Entry]]:
    """Each different content once, with its merged entry; memory stays near ``limit``."""
    held: dict[bytes, Entry] = {}
    size, files, folder = 0, None, None
    fan = 1 << FAN_OUT_BITS
    deepest = 64 // FAN_OUT_BITS - 1

    def spill(content: bytes, entry: Entry) -> None:
        h = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")
        pickle.dump((content, entry), files[(h >> (FAN_OUT_BITS * level)) % fan], protocol=5)

    try:
        for content, entry in records:
            if files is not None:
                spill(content, entry)
                continue
            known = held.get(content)
            held[content] = entry if known is None else better(known, entry)
            if known is None:
                size += len(content) + 200
                if size > limit and len(held) > 1 and level <= deepest:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(os.path.join(folder.name, str(i)), "w+b") for i in range(fan)]
                    for item in held.items():
                        spill(*item)
                    held = {}
        yield from held.items()
        held = {}
        for f in files or ():
            f.seek(0)
            yield from grace(read_spilled(f), limit, level + 1)
            f.truncate(0)
    finally:
        for f in files or ():
            f.close()
        if folder is not None:
            folder.cleanup()


def read_spilled(f) -> Iterator[tuple[bytes, Entry]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _first_pass(limit: int):
    blanks = BLANKS.encode()
    schema = pa.schema([("content", pa.binary()), ("n", pa.int64()), ("id", pa.int64()), ("rows", pa.int64())])

    def records(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            lengths = batch.column("n").to_pylist()
            for doc_id, n, text in zip(ids, lengths, text_bytes(batch.column("text"))):
                yield text.translate(None, blanks), (n, doc_id, 1)

    def run(batches):
        for out in chunks(grace(records(batches), limit)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in out], pa.binary()), *(pa.array([e[k] for _, e in out], pa.int64()) for k in range(3))],
                schema=schema)

    return run


def _second_pass(limit: int):
    schema = pa.schema([("text_sha256", pa.string()), ("keep_n", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def records(batches):
        for batch in batches:
            content = batch.column("content").to_pylist()
            yield from zip(content, zip(*(batch.column(k).to_pylist() for k in ("n", "id", "rows"))))

    def run(batches):
        for out in chunks(grace(records(batches), limit)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(c).hexdigest() for c, _ in out], pa.string()),
                 *(pa.array([e[k] for _, e in out], pa.int64()) for k in range(3))], schema=schema)

    return run


def chunks(items: Iterable, rows: int = 1000, size: int = 8 << 20) -> Iterator[list]:
    """Lists of at most ``rows`` items and about ``size`` bytes of content."""
    out, held = [], 0
    for item in items:
        out.append(item)
        held += len(item[0])
        if len(out) >= rows or held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def copy_groups(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row for each different text: text_sha256, keep_n, keep_id, group_size."""
    rows = only_text(docs).withColumn("n", F.length("text"))
    first = rows.mapInArrow(_first_pass(limit), "content binary, n long, id long, rows long")
    return first.repartition(F.xxhash64("content")).mapInArrow(
        _second_pass(limit), "text_sha256 string, keep_n long, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """All columns of ``docs`` with keep_id, group_size, kept and text_sha256.

    Two texts are copies when they are equal without blanks, tabs, newlines, vertical
    tabs, form feeds and returns; a null text counts as empty, and all empty texts are
    one group.  The row with the most code points stays, then the one with the
    smallest id (a null id last).  Of rows that repeat the same id and an equally long
    copy, exactly one stays.  An empty table gives an empty result.  Columns of ``docs``
    that carry one of the four names are replaced.
    """
    rows = _with_keys(docs.drop("keep_id", "group_size", "kept", "text_sha256")).withColumn(
        "__first", F.row_number().over(Window.partitionBy("__sha", "doc_id", "__n").orderBy("__n")) == 1)
    joined = rows.join(_groups(docs, limit), "__sha")
    kept = docs.drop("keep_id", "group_size", "kept", "text_sha256").columns
    return joined.select(*kept, F.col("__keep_id").alias("keep_id"), F.col("__size").alias("group_size"),
                         (_is_best() & F.col("__first")).alias("kept"), F.col("__sha").alias("text_sha256"))


def without_copies(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; see exact_duplicates."""
    def known(c: str):
        return F.coalesce(F.col(c).cast("long"), F.lit(-2**63))  # a null id is an id as well

    best = _groups(docs, limit).select("__sha", F.coalesce("__keep_n", F.lit(0)).alias("__n"), known("__keep_id").alias("__id"))
    # Dealt by all three, a large group is no hot key, and repeated rows are together already.
    kept = _with_keys(docs).withColumn("__id", known("doc_id")).join(best, ["__sha", "__id", "__n"], "left_semi")
    return kept.dropDuplicates(["__sha", "__id", "__n"]).select(*docs.columns)


def _with_keys(docs: DataFrame) -> DataFrame:
    """Keys that are never null by type: a test for null would compute the digest again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "__sha": F.coalesce(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256), F.lit("")),
        "__n": F.coalesce(F.length(text).cast("long"), F.lit(0)),
    })


def _groups(docs: DataFrame, limit: int) -> DataFrame:
    return copy_groups(docs, limit).toDF("__sha", "__keep_n", "__keep_id", "__size")


def _is_best():
    return F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__n") == F.col("__keep_n"))

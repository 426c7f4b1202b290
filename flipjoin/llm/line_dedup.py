"""Substring deduplication by hashing lines and the sentences in them.

A line is a unit, and so is each of its sentences, which end after a mark followed by
white space.  Units are normalised (white space folded, A-Z in lower case) and reduced
to a 128-bit digest, once, and stored.  The earliest occurrence of a digest, by document
id and then by place, stays.  What repeats it is removed:

* a line that repeats an earlier line or sentence, however short it is;
* sentences inside other lines where a run of them, one after the other and across the
  ends of lines, repeats earlier units over ``min_run`` bytes or more.  So a passage is
  found however its sentences are dealt to lines, and a lone short sentence stays where it
  is.  (A line end inside a sentence makes two units of it.)

The global step is a minimum for each digest, combined before the shuffle, and joined
back to the occurrences: no group of equal units is ever gathered.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, only_text, row_key, small_batches, stored, text_bytes

#: Bytes of normalised text that a run of repeated sentences takes at least.
MIN_RUN = 120
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: The marks and what follows them at the end of a sentence.
SENTENCE_END = re.compile(rb"[.!?][\x20\x09\x0B-\x0D]+")


def sentences(line: bytes) -> list[bytes]:
    """A line cut after its sentences; white space stays with the one before it."""
    at, out = 0, []
    for end in SENTENCE_END.finditer(line):
        out.append(line[at:end.end()])
        at = end.end()
    return [*out, line[at:]]


def normalised(unit: bytes) -> bytes:
    return b" ".join(unit.lower().split())


def units(docs: DataFrame, unit: str = "line") -> DataFrame:
    """One row a unit: row_key, doc_id, line, k, d1, d2.

    ``k`` counts the sentences of a line that are not blank; -1 is the line itself, where
    it has two or more of them.
    """
    sep = SEPARATORS[unit].encode()
    fields = [("row_key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("k", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]
    schema = pa.schema(fields)

    def digests(text: bytes, line: list[int], k: list[int], out: bytearray) -> None:
        for number, part in enumerate(text.split(sep)):
            norms = [n for s in sentences(part) if (n := normalised(s))]
            if len(norms) > 1:
                norms.append(b" ".join(norms))
            for j, n in enumerate(norms):
                line.append(number)
                k.append(j if j == 0 or j + 1 < len(norms) else -1)
                out += hashlib.md5(n).digest()

    def run(batches):
        for batch in small_batches(batches, "text", 8 << 20):
            keys, ids, sizes = batch.column("row_key"), batch.column("doc_id"), []
            line, k, raw = [], [], bytearray()
            for text in text_bytes(batch.column("text")):
                before = len(line)
                digests(text, line, k, raw)
                sizes.append(len(line) - before)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            both = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([keys.take(owner), ids.take(owner), pa.array(line, pa.int32()), pa.array(k, pa.int32()),
                                              pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], schema=schema)

    rows = only_text(docs).select(row_key().alias("row_key"), "doc_id", "text")
    return rows.mapInArrow(run, "row_key long, doc_id long, line int, k int, d1 long, d2 long")


def repeated_units(docs: DataFrame, unit: str = "line") -> DataFrame:
    """row_key, line, k and ``later`` of every unit that occurs more than once.

    ``later`` is false for the earliest occurrence: the smallest doc_id (null last), then
    row_key, then the place.
    """
    found = stored(units(docs, unit), "units")
    at = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_key", "line", "k")
    first = found.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Stored, so that both sides of the join are dealt for it alone and a hot one can be split.
    first = stored(first, "first-units")
    out = stored(found.join(first, ["d1", "d2"]).select("row_key", "line", "k", (at > F.col("first")).alias("later")).distinct(), "repeated-units")
    discard(found, first)
    return out


def without_repeated_units(docs: DataFrame, unit: str = "line", min_run: int = MIN_RUN) -> DataFrame:
    """The documents with n_units, n_removed, removed (spans), longest_removed, longest_shared and kept_text.

    Units are sentences that are not blank.  ``removed`` lists what was removed as (start,
    end) in code points of the original text, one span for sentences side by side in a
    line; a line that is removed whole goes with one separator, and kept_text is what is
    left, in order.  ``longest_removed`` and ``longest_shared`` are the normalised bytes of
    the longest run of sentences that are removed, and that occur more than once, the
    earliest occurrence included.  A null or empty text has no unit.  Of rows that repeat
    an id and a text one is the earliest, and all units of the others are removed.
    Columns of ``docs`` with one of the six names are replaced; an empty table gives an
    empty result.
    """
    marks = repeated_units(docs, unit).groupBy(F.col("row_key").alias("__key")).agg(
        F.collect_list(F.struct("line", "k", "later")).alias("__marks"))  # at most the units of one document
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ("n_units", "n_removed", "removed", "longest_removed", "longest_shared", "kept_text")
    rows = docs.drop(*names).withColumn("__key", F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))))
    copy = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1))) > 1
    judged = rows.join(marks, "__key", "left").withColumn("__copy", copy).withColumn(
        "__cut", _cutter(SEPARATORS[unit], min_run)(text, "__marks", "__copy"))
    return judged.drop("__key", "__marks", "__copy").withColumns({
        "n_units": F.col("__cut.n_units"),
        "n_removed": F.col("__cut.n_removed"),
        "removed": F.arrays_zip(F.col("__cut.starts").alias("start"), F.col("__cut.ends").alias("end")),
        "longest_removed": F.col("__cut.longest_removed"),
        "longest_shared": F.col("__cut.longest_shared"),
        "kept_text": F.col("__cut.kept"),
    }).drop("__cut")


def _cutter(sep: str, min_run: int):
    columns = ["n_units", "n_removed", "starts", "ends", "longest_removed", "longest_shared", "kept"]

    @F.pandas_udf("n_units long, n_removed long, starts array<long>, ends array<long>, longest_removed long, longest_shared long, kept string")
    def cut(text: pd.Series, marks: pd.Series, copy: pd.Series) -> pd.DataFrame:
        rows = [cut_text(t, () if m is None else [(r["line"], r["k"], r["later"]) for r in m], c, sep, min_run)
                for t, m, c in zip(text, marks, copy)]
        return pd.DataFrame(rows, columns=columns)

    return cut


def cut_text(text: str, marks, copy: bool, sep: str, min_run: int) -> tuple:
    """What of a text goes; ``copy`` says that all of it stands earlier."""
    status = {(line, k): later for line, k, later in marks}
    lines = [sentences(x.encode()) for x in text.split(sep)]
    norms = [[normalised(s) for s in line] for line in lines]
    size, shared, repeated, whole = [], [], [], []  # of the sentences that are not blank
    for number, line in enumerate(norms):
        n = sum(map(bool, line))
        sure = status.get((number, 0 if n == 1 else -1))
        k = 0
        for x in filter(None, line):
            size.append(len(x))
            own = status.get((number, k))
            shared.append(copy or own is not None or sure is not None)
            whole.append(copy or bool(sure))
            repeated.append(copy or bool(own) or bool(sure))
            k += 1
    run = run_sizes(size, repeated)
    gone = [w or (r and n >= min_run) for w, r, n in zip(whole, repeated, run)]
    starts, ends, kept, at, i = [], [], [], 0, 0
    for line, norm in zip(lines, norms):
        left, before = [], i
        open_span = False
        for s, x in zip(line, norm):
            n = len(s.decode())
            if x and gone[i]:
                if open_span:
                    ends[-1] = at + n
                else:
                    starts.append(at)
                    ends.append(at + n)
                open_span = True
            else:
                left.append(s)
                open_span = False
            i += bool(x)
            at += n
        if i == before or not all(gone[before:i]):
            kept.append(b"".join(left).decode())
        at += len(sep)
    longest = lambda flags: max(run_sizes(size, flags), default=0)
    return len(size), sum(gone), starts, ends, longest(gone), longest(shared), sep.join(kept)


def run_sizes(size: list[int], flags: list[bool]) -> list[int]:
    """For each place the sum of ``size`` over the run of true flags it is in, else 0."""
    out, i = [0] * len(size), 0
    while i < len(size):
        j = i
        while j < len(size) and flags[j]:
            j += 1
        out[i:j] = [sum(size[i:j])] * (j - i)
        i = j + 1
    return out

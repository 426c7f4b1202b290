"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Of two or fewer
differing bits none falls into at least one segment, so that segment is equal and the
next one differs in at most two bits.  The binary Golay code is perfect: every 23-bit
word is within three bits of exactly one codeword, and two words at most two bits
apart have a word within one bit of both.  Decoding a segment and its 23 neighbours
gives one or six codeword indices, and two such segments share one.  So the keys of a
fingerprint are (segment, its value, an index of the next segment), about 16 of them;
fingerprints that share a key are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_text, row_key, stored, text_bytes
from .components import components

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the code (fixed value).
GENERATOR = 0b101011100011
RADIUS = 2
#: A group larger than this is cut by the index of the third segment.
GROUP = 4096


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Bits set in more than half of the XXH64 (seed 42) of the shingles."""
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), 0
    raw = bytearray()
    for s in shingles:
        raw += digest(s, 42)
        if len(raw) >= 1 << 19:
            ones += _bit_counts(raw)
            n += len(raw) // 8
            raw = bytearray()
    ones += _bit_counts(raw)
    n += len(raw) // 8
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _bit_counts(raw: bytearray) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, row_key, fp (the 64 bits as a BIGINT) for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.lower().split(), width) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(fps, np.uint64).view(np.int64))], schema=schema)

    return only_text(docs).withColumn("row_key", row_key()).mapInArrow(run, "doc_id long, row_key long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word, and the error pattern of each syndrome."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    syndromes = np.array([[remainder((b << 8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[remainder(e)] = e
    return syndromes, errors


def golay_indices(words: np.ndarray, tables=None) -> np.ndarray:
    """For each 23-bit word a row of 24 codeword indices, of itself and its neighbours."""
    syndromes, errors = tables or golay_tables()
    near = words.astype(np.uint32)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    s = syndromes[0][near & 255] ^ syndromes[1][(near >> 8) & 255] ^ syndromes[2][near >> 16]
    return (near ^ errors[s]) >> 11


def _unique_in_rows(x: np.ndarray) -> np.ndarray:
    """Marks the first of each value in a row; sorts ``x`` in place."""
    x.sort(axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    return new


def _segment(fps: np.ndarray, k: int) -> np.ndarray:
    at, bits = SEGMENTS[k]
    return (fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)


def _keys():
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(3):
                index = golay_indices(_segment(fps, (k + 1) % 3), tables)
                new = _unique_in_rows(index)
                row, _ = np.nonzero(new)
                key = ((np.int64(k) << 35) | (_segment(fps, k)[row].astype(np.int64) << 12) | index[new].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], schema=schema)

    return run


def spanning_links(fps: np.ndarray, k: int, tables) -> list[tuple[int, int]]:
    """Links that join what is linked within one group, at most one a fingerprint.

    A large group is first cut by the indices of the third segment, which linked
    fingerprints also share; the links of a part then join what that part links.
    """
    if len(fps) > GROUP:
        index = golay_indices(_segment(fps, (k + 2) % 3), tables)
        new = _unique_in_rows(index)
        row, _ = np.nonzero(new)
        part = index[new]
        order = np.argsort(part, kind="stable")
        row, part = row[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        return [x for r in np.split(row, cuts) if len(r) > 1 for x in _links(fps[r])]
    return _links(fps)


def _links(left: np.ndarray) -> list[tuple[int, int]]:
    out = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                hits = left[near]
                left = left[~near]
                out += [(int(x), int(h)) for h in hits]
                frontier += list(hits)
    return out


def _group_links():
    """Links within runs of equal keys of sorted rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(pairs):
        x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], schema=schema)

    def groups(keys, fps, tables):
        pairs = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]  # most groups that are no single row
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS
        pairs += list(zip(fps[two][near].tolist(), fps[two + 1][near].tolist()))
        for g in np.flatnonzero(sizes > 2):
            pairs += spanning_links(fps[cuts[g]:cuts[g + 1]], int(keys[cuts[g]] >> 35), tables)
        return pairs

    def run(batches):
        tables = golay_tables()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # where the open group begins
            if last == 0 and held and held[-1][0][-1] == keys[0]:
                held.append((keys, fps))
                continue
            held.append((keys[:last], fps[:last]))
            if pairs := groups(*map(np.concatenate, zip(*held)), tables):
                yield batch_of(pairs)
            held = [(keys[last:], fps[last:])]
        if held and (pairs := groups(*map(np.concatenate, zip(*held)), tables)):
            yield batch_of(pairs)

    return run


def links(distinct: DataFrame) -> DataFrame:
    """a, b: verified links between the different fingerprints in ``distinct`` (fp).

    Any two fingerprints at most two bits apart are joined by a path of links.
    """
    keyed = distinct.select("fp").mapInArrow(_keys(), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_group_links(), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, row_key, fp, component_id for every row of ``docs``.

    Rows that repeat an id and a text share their row_key.  Rows whose fingerprints are at most two bits apart are linked; component_id is the
    smallest doc_id that links lead to, itself included (null only if all are null).
    Texts without words (null, empty, blank) have fingerprint zero and are linked like
    any other.  Equal fingerprints are one before any pair is looked at, so a large group
    of copies costs one key; repeated rows each give a row.  An empty table gives an
    empty result; other columns are not read.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct)).withColumnRenamed("node", "fp")
    known = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "label").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "row_key", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component with the columns of ``docs``: that of the smallest id.

    Rows that repeat this id and its text leave one; components without any id keep
    one row for each different text, and a null text is the empty one.
    """
    found = near_duplicates(docs, width).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.select(F.col("row_key").alias("__key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__key", F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))))
    return keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)

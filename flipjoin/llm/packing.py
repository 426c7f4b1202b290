"""Packing tokenised documents into sequences by sum of squares.

Each document is put where the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest, so that no gap piles up that later documents
cannot fill.  Pieces are dealt evenly to groups of a bounded number, packed
independently; full pieces need no search.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_text, process_state, stored

CAPACITY, END_ID = 1024, 2
#: Pieces that one task packs.
GROUP_PIECES = 1 << 14
#: The public pattern of the byte-level vocabulary (fixed value), without its look-ahead.
SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Ids of a text as little-endian 32-bit numbers, equal to the tokenizer's.

    The tokenizer's pattern looks ahead only to keep the last blank of a run for the
    word after it.  A text whose white spaces are single blanks and newlines between
    words has no runs, so a pattern without that, which is several times as fast, cuts it
    alike, and the merges of the rank file are the tokenizer's.  Every other text, and
    any with a special token's string or characters outside the Latin blocks, goes to
    the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.runs = ["  ", "\n\n", " \n", "\n ", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.odd = re.compile(r"[^\n\x20-\x7e\xa1-ɏ‘-”–—…]")
        self.ranks = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SINGLE_SPACED, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if (self.ranks is None or text[0] in " \n" or text[-1] in " \n" or any(r in text for r in self.runs)
                or self.odd.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """The encoder of this process; without paths that of the public 50k byte-level BPE."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    state = process_state()
    if state.get("encoder_of") != tokenizer:
        state["encoder"], state["encoder_of"] = Encoder(tokenizer, ranks), tokenizer
    return state["encoder"]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, **paths) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and turn, which deals them out.

    A document is its ids and ``end_id``.  One longer than ``capacity`` is cut so that
    all pieces but the first are full.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    end = np.uint32(end_id).tobytes()

    def run(batches):
        encode = encoder(**paths)
        task = TaskContext.get()
        turn = count((task.partitionId() if task else 0) * 7919)
        for batch in batches:
            rows = []
            doc_ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(doc_ids, texts):
                ids = encode(text) + end
                n = len(ids) // 4
                view = memoryview(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(view[4 * a:4 * b]), next(turn)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if name == "piece" else pa.int64()) for name, c in zip(names, columns)], names=names)

    return only_text(docs).mapInArrow(run, PIECES)


class SumOfSquares:
    """Open sequences by residual gap, and where the next piece goes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # by gap; gaps 0 and capacity stay 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.number = count()

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece: the least change of the sum, then the tightest.

        A new sequence is opened only where no open one has room.
        """
        room = self.open[size:self.capacity]  # gaps size, size + 1, ...
        if room.any():
            change = 1 - 2 * room
            change[1:] += 2 * self.open[1:len(room)] + 1
            change[room == 0] = np.iinfo(np.int64).max
            gap = size + int(change.argmin())
        else:
            gap = self.capacity
        if gap == self.capacity:
            number = next(self.number)
        else:
            number = self.bins[gap].pop()
            self.open[gap] -= 1
        if gap > size:
            self.bins[gap - size].append(number)
            self.open[gap - size] += 1
        return number, self.capacity - gap


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    state = SumOfSquares(capacity)
    for i in np.argsort(-lengths, kind="stable"):
        sequence[i], offset[i] = state.place(int(lengths[i]))
    return sequence, offset


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, **paths) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    Pieces of a sequence lie without gaps from offset 0, ``capacity`` at most in all.
    Groups hold about ``group_pieces`` pieces; with thousands of pieces in each, what a
    group leaves open at its end is a small part of it.  A null or empty text is the
    single ``end_id``; repeated rows are packed once each; an empty table gives an empty
    result; other columns are not read.  ``tokenizer`` and ``ranks`` are paths.
    """
    cut = stored(pieces(docs, capacity, end_id, **paths), "pieces")
    counts = {r["short"]: r["count"] for r in cut.groupBy((F.col("length") < capacity).alias("short")).count().collect()}
    groups, more = (max(1, -(-counts.get(short, 0) // group_pieces)) for short in (True, False))

    def run(key, group):
        sequence, offset = pack_lengths(group.column("length").to_numpy(), capacity)
        first = (int(key[0].as_py()) << 40)
        return group.drop_columns(["turn", "group"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    # Full pieces need no neighbours and go to groups of their own.
    spread = F.when(F.col("length") < capacity, F.col("turn") % groups).otherwise(groups + F.col("turn") % more)
    return cut.withColumn("group", spread.cast("long")).groupBy("group").applyInArrow(run, PLACED)

"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting over an add-one
unigram model.  Words are numbered by shard (a hash range) and rank.  The first level of
the trie holds the words of a shard: their hashes and counts.  It is written to the
shared folder, uncompressed, so that a blob lies in its file as it is; executors fetch
these files once and map them.  The second level is cut into parts by context, a word of
very many occurrences into several by its successors.  A part holds its contexts,
their back-off weights, monotone pointers to their successors, and those as pointer * M
+ word, which is monotone as well, with quantised log probabilities.  Hashes, contexts,
pointers and successors are Elias-Fano coded.

Counting is a shuffle of tallies: each task sends what it has added up.  No task and no
executor ever needs the second level as a whole: a text sends its pairs to their parts,
Elias-Fano coded, each part is searched where it is, one row of pairs after the other,
and sends back a sum for each text.  Tallies, pairs and parts grow with the input, and
so do the parts in number; what a task holds at a time does not.

Pairs that make up a fixed share of all tokens, of which there can be only so many, are
looked up in the trie once and their scores sent to everyone, so a pair that most texts
hold does not go to one task over and over.

All pairs of training are kept, and the probabilities of a context add up to one.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, only_text, process_state, shared_folder, stored, text_bytes
from .elias_fano import EliasFano, coded, mapped, pack, packed, prefixed
from .numhash import Words, mix, text_groups

MOD, HELD_OUT = 7, 2
#: Bytes of text that are looked up together, and tallies a task holds before it sends them.
TOGETHER, TALLIES = 8 << 20, 4_000_000
#: Bytes of text that are hashed at a time: sums and products of eight bytes each for every byte.
HASHED = 1 << 20
#: Training tokens of a part of the second level, and of a context in one part.
PART_TOKENS, CONTEXT_TOKENS = 1 << 20, 1 << 18
#: A pair that is more than one in so many tokens, and occurs more than so often, is known everywhere.
FREQUENT, FREQUENT_LEAST = 1 << 16, 64
#: Log probabilities are multiples of this, down to -16.
STEP = 1 / 4096
END = np.uint64(0)


class Tally:
    """Counts by key, kept sorted; ``take`` empties it."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > TALLIES and len(self.parts) > 1:
            merged = self.take()
            self.parts, self.size = [merged], len(merged[0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return added_up(keys, counts)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally_rows(keys: np.ndarray, counts: np.ndarray, part: np.ndarray):
    """Rows (part, keys, counts), a row for each part; keys stay in order."""
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    cuts = [*first, len(part)]
    rows = [(int(part[a]), keys[a:b].tobytes(), _narrow(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        names=["part", "keys", "counts"])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the smallest type that holds them; the number of keys tells which."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return counts.astype(kind).tobytes()
    return counts.astype(np.int64).tobytes()


def _tallies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All tallies of a group of rows, added up."""
    keys, counts = [], []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        keys.append(np.frombuffer(k, np.uint64))
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(c) * 8 // len(k)] if k else np.uint8
        counts.append(np.frombuffer(c, kind).astype(np.int64))
    return added_up(np.concatenate(keys), np.concatenate(counts))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text, and the text of each."""
    hashes, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in text_groups(texts, HASHED):
        words = Words(texts[a:b])
        ends = words.first[1:]
        hashes.append(np.insert(np.maximum(words.hash, np.uint64(1)), ends, END))
        of.append(np.insert(words.text, ends, np.arange(b - a)) + a)
        del words  # its sums go before the next are made
    return np.concatenate(hashes), np.concatenate(of)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Levels:
    """Where the first level is: its files and what they add up to, and how the second is cut."""

    shards: int
    words: int
    tokens: int
    offsets: tuple[int, ...]
    word_files: tuple[str, ...]
    parts: int
    context_tokens: int
    #: Occurrences that a pair known everywhere exceeds; fewer than FREQUENT pairs can.
    frequent: int

    @property
    def tasks(self) -> int:
        """Shuffle partitions for rows by part: few parts fall together, at any size."""
        return 2 * self.parts

    @property
    def base(self) -> np.uint64:
        """A pair is context * base + word; the word ``words`` is any that is not in training."""
        return np.uint64(self.words + 1)

    def opened(self) -> Vocabulary:
        """The first level, mapped once in each process."""
        state = process_state()
        if state.get("words_of") != self.word_files:
            state["words"], state["words_of"] = Vocabulary(self), self.word_files
        return state["words"]


class Vocabulary:
    """The mapped first level."""

    def __init__(self, levels: Levels):
        self.levels = levels
        self.blobs = {int(b["shard"][0]): b for f in levels.word_files for b in mapped(SparkFiles.get(f))}
        self.hashes = {s: coded("hashes", b) for s, b in self.blobs.items()}
        self.offsets = np.array(levels.offsets)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: not in training) and count of words given by sorted hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = _shard(hashes, self.levels.shards)
        cuts = np.searchsorted(shard, np.arange(self.levels.shards + 1))
        for s, words in self.hashes.items():
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                at, known = words.successor(hashes[a:b])
                out[a:b][known] = self.offsets[s] + at[known]
                count[a:b][known] = self.blobs[s]["counts"][at[known]]
        return out, count

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Count of each number; zero for numbers of no word."""
        unique, each = np.unique(ids, return_inverse=True)
        cuts = np.searchsorted(unique, np.append(self.offsets, self.levels.words))
        out = np.zeros(len(unique), np.int64)
        for s in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[s], cuts[s + 1]
            out[a:b] = self.blobs[int(s)]["counts"][unique[a:b] - self.offsets[s]]
        return out[each]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.levels.tokens + self.levels.words + 1))

    def part_of(self, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The part of a pair, from the context's count: a context of many goes to several, by word."""
        pieces = np.maximum(-(-count // self.levels.context_tokens), 1)
        piece = np.where(pieces > 1, (mix(word.astype(np.uint64)) % pieces.astype(np.uint64)).astype(np.int64), 0)
        return self.part(context, piece)

    def part(self, context: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64)) % np.uint64(self.levels.parts)).astype(np.int64)


class Part:
    """A part of the second level."""

    def __init__(self, blob: dict[str, np.ndarray], words: Vocabulary):
        self.blob, self.words = blob, words
        self.contexts, self.pointers, self.successors = (coded(n, blob) for n in ("contexts", "pointers", "successors"))

    def log_probability(self, pairs: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of sorted pairs, by a search among the successors of the context."""
        base = self.words.levels.base
        context, word = pairs // base, pairs % base
        unique, each = np.unique(context, return_inverse=True)
        local, known = self.contexts.successor(unique)
        if not known.all():
            raise ValueError("a context of training is not in its part")
        first, end = (self.pointers.access(local + k).astype(np.int64)[each] for k in (0, 1))
        at, found = self.successors.successor(first.astype(np.uint64) * base + word, first, end)
        found &= first < end
        out = self.words.unigram(self.words.counts(word.astype(np.int64))) + self.blob["back_off"][local][each] * -STEP
        if len(self.blob["scores"]):
            out = np.where(found, self.blob["scores"][np.minimum(at, len(self.blob["scores"]) - 1)] * -STEP, out)
        return out


class Frequent:
    """Scores of the frequent pairs, as the trie has them."""

    def __init__(self, parts: DataFrame):
        rows = parts.select(F.explode(F.arrays_zip("frequent", "frequent_scores")).alias("x")).select("x.*").collect()  # fewer than FREQUENT
        pairs = np.array([r["frequent"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(pairs)
        self.pairs, self.scores = pairs[order], np.array([r["frequent_scores"] for r in rows], np.uint16)[order]

    def log_probability(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(word | context), and whether the pair is frequent; any number where it is not."""
        if not len(self.pairs):
            return np.zeros(len(pairs)), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return self.scores[at] * -STEP, self.pairs[at] == pairs


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def _files(rows: DataFrame, spark: SparkSession, name: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Store rows with a blob each, let executors fetch the files, and give their names."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = rows.schema
    rows.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    del rows
    spark.sparkContext._jvm.System.gc()  # the shuffle files of this step go
    kept = spark.read.schema(schema).parquet(path)
    files = kept.inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return kept, tuple(os.path.basename(f) for f in files)


def train_words(docs: DataFrame) -> Levels:
    """The first level, learned from all rows of ``docs`` (text); it stays in the shared folder."""
    spark = docs.sparkSession
    shards = max(8, docs.rdd.getNumPartitions())

    def count_words(batches):
        tally = Tally()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in text_groups(texts, TOGETHER):
                tally.add(*np.unique(token_hashes(texts[a:b])[0], return_counts=True))
                if tally.size > TALLIES:
                    keys, counts = tally.take()
                    yield _tally_rows(keys, counts, _shard(keys, shards))
        keys, counts = tally.take()
        if len(keys):
            yield _tally_rows(keys, counts, _shard(keys, shards))

    def word_level(key, group):
        keys, counts = _tallies(group)
        shard = int(key[0].as_py())
        blob = pack({"shard": np.array([shard]), "counts": counts if counts.max() >= 2**32 else counts.astype(np.uint32),
                     **prefixed("hashes", EliasFano.of(keys))})
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())], "blob": pa.array([blob], pa.binary())})

    kept, files = _files(docs.select("text").mapInArrow(count_words, TALLY_ROW).groupBy("part").applyInArrow(
        word_level, "shard int, words long, tokens long, blob binary"), spark, "words")
    sizes = {r["shard"]: (r["words"], r["tokens"]) for r in kept.select("shard", "words", "tokens").collect()}
    in_shards = [sizes.get(s, (0, 0)) for s in range(shards)]
    offsets = np.cumsum([0, *(w for w, _ in in_shards)])
    tokens = sum(t for _, t in in_shards)
    return Levels(shards, int(offsets[-1]), tokens, tuple(offsets[:-1].tolist()), files, parts=max(8, -(-tokens // PART_TOKENS)),
                  context_tokens=CONTEXT_TOKENS, frequent=max(FREQUENT_LEAST, -(-tokens // FREQUENT)))


TALLY_ROW = "part int, keys binary, counts binary"


def train_pairs(docs: DataFrame, levels: Levels) -> DataFrame:
    """The second level as rows (part, blob, frequent pairs and their scores), stored; a part without pairs has no row."""
    def count_pairs(batches):
        words, tally = levels.opened(), Tally()

        def rows():
            keys, counts = tally.take()
            context = (keys // levels.base).astype(np.int64)
            return _tally_rows(keys, counts, words.part_of(context, words.counts(context), (keys % levels.base).astype(np.int64)))

        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in text_groups(texts, TOGETHER):
                ids = numbered(words, token_hashes(texts[a:b])[0])[0].astype(np.uint64)
                tally.add(*np.unique(before(ids) * levels.base + ids, return_counts=True))
                if tally.size > TALLIES:
                    yield rows()
        if tally.size:
            yield rows()

    def added(key, group):
        """One row a part; for contexts that lie in several parts, how many successors are in this one."""
        keys, counts = _tallies(group)
        words = levels.opened()
        context, kinds = np.unique((keys // levels.base).astype(np.int64), return_counts=True)
        wide = words.counts(context) > levels.context_tokens
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([_narrow(counts)], pa.binary()),
                         "ones": [int((counts == 1).sum())], "twos": [int((counts == 2).sum())],
                         "wide": pa.array([context[wide]], pa.list_(pa.int64())), "kinds": pa.array([kinds[wide]], pa.list_(pa.int64()))})

    pairs = stored(docs.select("text").mapInArrow(count_pairs, TALLY_ROW).repartition(levels.tasks, "part").groupBy("part").applyInArrow(
        added, TALLY_ROW + ", ones long, twos long, wide array<long>, kinds array<long>"), "pairs")
    ones, twos = pairs.agg(F.sum("ones"), F.sum("twos")).first()
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5

    def to_parts(batches):
        """The successors of a context in all, for each part that holds some of them."""
        words = levels.opened()
        for batch in batches:
            context, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("context", "kinds"))
            pieces = -(-words.counts(context) // levels.context_tokens)
            each = np.repeat(np.arange(len(context)), pieces)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pa.RecordBatch.from_arrays([pa.array(words.part(context[each], piece).astype(np.int32)), pa.array(context[each]), pa.array(kinds[each])],
                                             names=["part", "context", "kinds"])

    wide = pairs.select(F.explode(F.arrays_zip("wide", "kinds")).alias("x")).groupBy(F.col("x.wide").alias("context")).agg(F.sum("x.kinds").alias("kinds"))
    wide = wide.mapInArrow(to_parts, "part int, context long, kinds long")
    rows = pairs.select("part", "keys", "counts", F.lit(None).cast("long").alias("context"), F.lit(None).cast("long").alias("kinds")).unionByName(
        wide.select("part", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "context", "kinds"))

    def pair_level(key, group):
        words = levels.opened()
        tallies = group.filter(group.column("keys").is_valid())
        keys, counts = _tallies(tallies) if len(tallies) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        more = group.filter(group.column("context").is_valid())
        of_more = dict(zip(more.column("context").to_pylist(), more.column("kinds").to_pylist()))
        context = (keys // levels.base).astype(np.int64)
        contexts = np.union1d(context, np.array(list(of_more), np.int64)).astype(np.int64)
        of = words.counts(contexts)
        pointers = np.searchsorted(context, np.append(contexts, contexts[-1:] + 1)) if len(contexts) else np.zeros(1, np.int64)
        kinds = np.array([of_more.get(c, k) for c, k in zip(contexts.tolist(), np.diff(pointers).tolist())])
        back = discount * kinds / of  # every token has one after it, so the counts of a context add up to its own
        local = np.searchsorted(contexts, context)
        word = keys % levels.base
        p = (counts - discount) / of[local] + back[local] * 10 ** words.unigram(words.counts(word.astype(np.int64)))
        scores, often = quantised(np.log10(p)), counts > levels.frequent
        blob = pack({"back_off": quantised(np.log10(np.maximum(back, 1e-16))), "scores": scores,
                     **prefixed("contexts", EliasFano.of(contexts)), **prefixed("pointers", EliasFano.of(pointers)),
                     **prefixed("successors", EliasFano.of(pointers[local].astype(np.uint64) * levels.base + word))})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary()),
                         "frequent": pa.array([keys[often].view(np.int64)], pa.list_(pa.int64())),
                         "frequent_scores": pa.array([scores[often].astype(np.int32)], pa.list_(pa.int32()))})

    out = stored(rows.repartition(levels.tasks, "part").groupBy("part").applyInArrow(
        pair_level, "part int, blob binary, frequent array<long>, frequent_scores array<int>"), "successors")
    discard(pairs)
    return out


def numbered(words: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each token."""
    unique, each = np.unique(hashes, return_inverse=True)
    ids, counts = words.ids(unique)
    return ids[each], counts[each]


def before(ids: np.ndarray) -> np.ndarray:
    """The token before each; before the first of a text stands the end of the one before.

    The very first has the last, which is an end as well.
    """
    return np.roll(ids, 1)


SENT = "part int, kind int, chunk string, body binary"


def sent_pairs(rows: DataFrame, levels: Levels, frequent: Frequent) -> DataFrame:
    """Rows for parts (kind 1: the pairs of a chunk of texts) and for nobody (kind 2: the chunk itself).

    A chunk is named by its task and its number there, the same if the task is run again.
    What needs no part is in the chunk: sums over tokens after a word that is not in
    training, and over frequent pairs.
    """
    names = ["part", "kind", "chunk", "body"]

    def run(batches):
        words = levels.opened()
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in text_groups(texts, TOGETHER):
                hashes, text = token_hashes(texts[a:b])
                ids, counts = numbered(words, hashes)
                base, n = words.unigram(counts), b - a
                context = before(ids)
                open_ = context >= 0
                w = np.where(ids < 0, levels.words, ids)[open_]
                pairs, doc = context[open_].astype(np.uint64) * levels.base + w.astype(np.uint64), text[open_]
                log, often = frequent.log_probability(pairs)
                known = np.bincount(text[~open_], base[~open_], minlength=n) + np.bincount(doc[often], log[often], minlength=n)
                chunk = pack({"doc_id": _numbers(batch.column("doc_id").slice(a, n)), "has_id": np.array(batch.column("doc_id").slice(a, n).is_valid()).astype(np.uint8),
                              "held_out": np.array(batch.column("held_out").slice(a, n)).astype(np.uint8),
                              "n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, counts > 0, minlength=n).astype(np.int64),
                              "base": np.bincount(text, base, minlength=n), "score": known.astype(np.float64)})
                name = f"{task}-{number}"
                number += 1
                out = [(-1 - number % 1024, 2, name, chunk)]
                part = words.part_of(context[open_][~often], before(counts)[open_][~often], w[~often])
                pairs, doc = pairs[~often], doc[~often].astype(np.uint16 if n < 1 << 16 else np.uint32)
                order = np.lexsort((pairs, part))
                pairs, part, doc = pairs[order], part[order], doc[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(part)]):
                    if i < j:
                        out.append((int(part[i]), 1, name, pack({"doc": doc[i:j], **prefixed("pairs", EliasFano.of(pairs[i:j]))})))
                for i in range(0, len(out), 256):
                    columns = zip(*out[i:i + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=names)

    return rows.mapInArrow(run, SENT)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def searched(levels: Levels):
    """Sums of log probabilities for each text of a chunk, from rows in order of part and kind."""
    names = ["chunk", "kind", "body"]

    def run(batches):
        words, part, number = levels.opened(), None, None
        for batch in batches:
            out = []
            for p, kind, chunk, body in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "chunk", "body"))):
                if kind == 2:
                    out.append((chunk, 2, body))
                elif kind == 0:
                    part, number = Part(packed(body), words), p
                else:
                    if number != p:
                        raise ValueError(f"part {p} is missing")
                    arrays = packed(body)
                    pairs = coded("pairs", arrays)
                    log = part.log_probability(pairs.access(np.arange(pairs.n)))
                    doc, each = np.unique(arrays["doc"], return_inverse=True)
                    out.append((chunk, 1, pack({"doc": doc, "sum": np.bincount(each, log).astype(np.float32)})))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary()))], names=names)

    return run


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from rows whose crc32(doc_id as text) mod 7 is not 2; a null id
    counts as the empty text.  A null or empty text is its end alone.  Words not in
    training have the probability of a count of zero, after one of these as the unigram
    has it.  Repeated rows count as often as they occur and each give a row; without
    training rows every token has probability one.  An empty table gives an empty
    result; other columns are not read.
    """
    rows = only_text(docs)
    held_out = crc_mod(F.col("doc_id"), MOD) == HELD_OUT
    levels = train_words(rows.filter(~held_out))
    parts = train_pairs(rows.filter(~held_out), levels)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def summed(key, group):
        kinds, bodies = group.column("kind").to_pylist(), group.column("body").to_pylist()
        chunk = packed(bodies[kinds.index(2)])
        score = chunk["score"].copy()
        for kind, body in zip(kinds, bodies):
            if kind == 1:
                more = packed(body)
                np.add.at(score, more["doc"].astype(np.int64), more["sum"].astype(np.float64))
        ids = pa.array(chunk["doc_id"], mask=chunk["has_id"] == 0)
        return pa.table([ids, pa.array(chunk["held_out"] == 1), pa.array(chunk["n_tokens"].astype(np.int64)), pa.array(chunk["n_known"]),
                         pa.array(np.full(len(score), levels.tokens)), pa.array(chunk["base"]), pa.array(score)], names=names)

    blobs = parts.select("part", F.lit(0).alias("kind"), F.lit("").alias("chunk"), F.col("blob").alias("body"))
    sent = sent_pairs(rows.withColumn("held_out", held_out), levels, Frequent(parts)).unionByName(blobs)
    # a part comes before its pairs, which pass it one row at a time
    sums = sent.repartition(levels.tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(searched(levels), "chunk string, kind int, body binary")
    # a chunk is about TOGETHER bytes of text, or one text
    return sums.groupBy("chunk").applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

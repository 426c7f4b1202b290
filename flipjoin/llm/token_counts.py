"""Token counts of a piece vocabulary by rank-synchronous merging of arrays.

A text is cut into pre-tokens that no piece of the vocabulary crosses.  Pre-tokens a
task has not met before are held as one ragged array of symbols: in each round every
sequence takes the pair of neighbours with its lowest rank, and all sequences merge
theirs at the same time, until no pair of any sequence is a piece.  What is left of a
sequence are its tokens.  Nothing is shuffled, and no text is encoded by a library.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only_text, process_state, small_batches, text_bytes

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: The mark that stands for a blank in pieces (fixed value).
BLANK = "▁"
#: Counts a process remembers before it starts anew, and the longest pre-token kept.
REMEMBERED, LONGEST_KEY = 1 << 20, 256
#: Symbols merged at a time.
SYMBOLS = 1 << 21
NO_RANK = np.int32(2**31 - 1)


@dataclass
class Merges:
    """A vocabulary as arrays: what two symbols merge to and when."""

    symbols: dict[str, int]      # single characters; all others cost their UTF-8 bytes
    keys: np.ndarray             # sorted left * size + right of the pairs that are pieces
    piece: np.ndarray            # the symbol of each pair
    rank: np.ndarray             # by symbol; equal scores have equal ranks
    alone: np.ndarray            # by symbol: no pair with it ranks as low as itself
    inner: set[str]              # all two neighbouring characters of any piece
    longest_run: int             # of blanks in one piece
    cut: re.Pattern

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair, NO_RANK where it is no piece."""
        key = left.astype(np.int64) * len(self.rank) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        merged = np.where(known, self.piece[at], 0)
        return np.where(known, self.rank[merged], NO_RANK), merged


def merges(pieces: list[tuple[str, float]]) -> Merges:
    """The arrays of (piece, score) with normal pieces only; a higher score merges first."""
    number = {p: i for i, (p, _) in enumerate(pieces)}
    scores = np.array([s for _, s in pieces])
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    found = sorted((number[p[:k]] * len(pieces) + number[p[k:]], i) for p, i in number.items()
                   for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
    keys, piece = np.array(found, np.int64).reshape(-1, 2).T
    alone = np.ones(len(pieces), bool)
    for side in (keys // len(pieces), keys % len(pieces)):
        alone[side[rank[piece] <= rank[side]]] = False
    inner = {p[k:k + 2] for p in number for k in range(len(p) - 1)}
    used = set("".join(inner))
    marks = "".join(c for c in map(chr, range(32)) if c not in used)  # tabs, newlines: never inside a piece
    apart = any(p[1] == BLANK and p[0] != BLANK for p in inner)
    if apart:
        raise ValueError("pieces with a blank after another character are not cut right")
    cut = re.compile(f"{BLANK}*[^{BLANK}{marks}]+|{BLANK}+" + (f"|[{marks}]" if marks else ""))
    runs = {len(p) for p in number if set(p) == {BLANK}}
    return Merges({p: i for p, i in number.items() if len(p) == 1}, keys, piece, rank, alone, inner, max(runs, default=1), cut)


def read_model(path: str) -> Merges:
    """The merges of a SentencePiece BPE model with byte fallback and no normalisation."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    # what the arrays take for granted: blanks become marks, one more in front, unknown characters become bytes
    if m.encode(" a  b", out_type=str) != [BLANK, BLANK + "a", BLANK, BLANK + "b"] or not any(map(m.is_byte, ids)):
        raise ValueError(f"{path} is no such model")
    normal = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return merges([(m.id_to_piece(i), m.get_score(i)) for i in normal])


def merged_sizes(m: Merges, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each sequence, and whether the first symbol is one mark still alone."""
    total = np.zeros(len(sequences), np.int64)
    bare = np.zeros(len(sequences), bool)
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    row = np.repeat(np.arange(len(sequences)), lengths)
    joined = "".join(sequences)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    values, inverse = np.unique(points, return_inverse=True)
    symbol_of = np.array([m.symbols.get(chr(v), -1) for v in values], np.int64)
    sym = symbol_of[inverse].reshape(-1)
    wide = np.select([points < 0x80, points < 0x800, points < 0x10000], [1, 2, 3], 4)  # bytes of a character
    lost = sym < 0
    np.add.at(total, row[lost], wide[lost] - 1)

    def neighbours(sym, row):
        rank, piece = m.pairs(sym[:-1], sym[1:])
        return np.append(np.where(row[:-1] == row[1:], rank, NO_RANK), NO_RANK), np.append(piece, 0)

    if not len(sym):
        return total, bare
    rank, piece = neighbours(sym, row)
    blank = m.symbols.get(BLANK, -2)
    while len(sym):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        done = best == NO_RANK
        if done.any():  # nothing left to merge: their symbols are counted and leave the arrays
            total[row[starts[done]]] += sizes[done]
            bare[row[starts[done]]] = sym[starts[done]] == blank
            live = np.repeat(~done, sizes)
            sym, row, rank, piece = sym[live], row[live], rank[live], piece[live]
            sizes, best = sizes[~done], best[~done]
            if not len(sym):
                break
        hit = rank == np.repeat(best, sizes)
        at = np.flatnonzero(hit)
        # Of overlapping occurrences every second one from the left; where a merged piece could
        # go on at once (its own pairs rank as low), the leftmost of the sequence alone.
        new_chain = np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))
        chain = np.maximum.accumulate(np.where(new_chain, np.arange(len(at)), 0))
        first = np.append(True, row[at[1:]] != row[at[:-1]])
        at = at[((np.arange(len(at)) - chain) % 2 == 0) & (m.alone[piece[at]] | first)]
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, row, rank, piece = sym[keep], row[keep], rank[keep], piece[keep]
        changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
        changed = changed[changed + 1 < len(sym)]
        r, p = m.pairs(sym[changed], sym[changed + 1])
        rank[changed] = np.where(row[changed] == row[changed + 1], r, NO_RANK)
        piece[changed] = p
        rank[-1] = NO_RANK
    return total, bare


def blank_sizes(m: Merges, lengths: np.ndarray) -> np.ndarray:
    """Tokens of runs of marks: the leftmost pair merges first, so full pieces split off in front."""
    table = merged_sizes(m, [BLANK * k for k in range(m.longest_run + 1)])[0]
    if m.longest_run > 1 and table[-1] != 1:
        return merged_sizes(m, [BLANK * int(k) for k in lengths])[0]
    return lengths // m.longest_run + table[lengths % m.longest_run]


def pieces_of(m: Merges, word: str) -> list[str]:
    """A long sequence cut where its two neighbouring characters are in no piece."""
    cuts = [0, *(k + 1 for k in range(len(word) - 1) if word[k:k + 2] not in m.inner), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def sizes_of(m: Merges, pretokens: list[str]) -> np.ndarray:
    """Tokens of each pre-token (marks, then anything without a mark)."""
    sequences, owner, marks = [], [], np.zeros(len(pretokens), np.int64)
    head = np.full(len(pretokens), -1, np.int64)
    for i, t in enumerate(pretokens):
        word = t.lstrip(BLANK)
        marks[i] = len(t) - len(word)
        if word:
            word = t[-len(word) - 1:] if marks[i] else word
            head[i] = len(sequences)
            parts = [word] if len(word) < 32 else pieces_of(m, word)
            sequences += parts
            owner += [i] * len(parts)
    out = np.zeros(len(pretokens), np.int64)
    total, bare = np.zeros(len(sequences), np.int64), np.zeros(len(sequences), bool)
    at, held = 0, 0
    for k, s in enumerate(sequences):  # about SYMBOLS at a time
        held += len(s)
        if held >= SYMBOLS or k + 1 == len(sequences):
            total[at:k + 1], bare[at:k + 1] = merged_sizes(m, sequences[at:k + 1])
            at, held = k + 1, 0
    np.add.at(out, owner, total)
    # the marks in front of a word: the last one is part of it unless it stayed alone
    led = (marks > 0) & (head >= 0)
    alone = np.zeros(len(pretokens), bool)
    alone[led] = bare[head[led]]
    run = marks - (led & ~alone)
    out -= alone
    return out + np.where(run > 0, blank_sizes(m, run), 0)


class Counter:
    """Counts texts, and remembers the pre-tokens it has met."""

    def __init__(self, m: Merges):
        self.m, self.known = m, {}

    def count(self, texts: list[str]) -> list[int]:
        cut = self.m.cut.findall
        lists = [cut(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({t for found in lists for t in found if t not in known})
        known.update(zip(new, sizes_of(self.m, new).tolist()))
        out = [sum(map(known.__getitem__, found)) for found in lists]
        for t in new:
            if len(t) > LONGEST_KEY:
                del known[t]
        return out


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Counts are those of ``model`` (a SentencePiece BPE model; default: the public one of
    32,000 pieces) without begin or end, with special strings in texts as plain text.
    A null text counts as empty and has no tokens; texts of any length are read whole.
    Repeated rows each give a row, a null id stays null, an empty table gives an empty
    result, and no other column is read.
    """
    import public_tokenizers

    path = model or public_tokenizers.path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        state = process_state()
        if ("tokens", path) not in state:
            state["tokens", path] = Counter(read_model(path))
        counter = state["tokens", path]
        for batch in small_batches(batches, "text", 2 << 20):
            raw = text_bytes(batch.column("text"))
            n = counter.count([t.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                schema=schema)

    return only_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

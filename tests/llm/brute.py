"""Plain single-process versions of the operators, for small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANKS = b" \t\n\x0b\x0c\r"


def op1(docs, length=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter()
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[hash(t[i:i + length])] += 1
    out = []
    for (doc_id, _), t in zip(docs, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i:i + length])] > 1:
                gone[i:i + length] = True
        gone[len(t)] = False
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    if not w:
        return []
    if len(w) < width:
        return [b" ".join(w)]
    return [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)]


def op4(docs, items, width=5):
    sets = {}
    for item_id, text in items:
        s = frozenset(shingles(text, width))
        if s:
            sets[s] = min(item_id, sets.get(s, item_id))
    out = []
    for doc_id, text in docs:
        w = words(text)
        have = {b" ".join(w[i:i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)}  # short items have short shingles
        hit = [i for s, i in sets.items() if len(s & have) * 10 >= len(s) * 8]
        out.append((doc_id, len(hit), min(hit, default=None), bool(hit)))
    return out


def op6(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").encode().translate(None, BLANKS)].append((doc_id, len(text or "")))
    out = []
    for content, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        done = False
        for r in rows:
            kept = r == keep and not done
            done |= kept
            out.append((r[0], keep[0], len(rows), kept, hashlib.sha256(content).hexdigest()))
    return out


def fingerprint(text, width=3):
    s = shingles(text, width)
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def op8(docs):
    fps = [(doc_id, fingerprint(t)) for doc_id, t in docs]
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    x = np.array(distinct, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 2) + i + 1:
            parent[root(distinct[i])] = root(distinct[j])
    least = {}
    for doc_id, f in fps:
        if doc_id is not None:
            least[root(f)] = min(doc_id, least.get(root(f), doc_id))
    return [(doc_id, f"{f:016x}", least.get(root(f))) for doc_id, f in fps]


def op9(docs, min_run=120):
    """docs in order of id, no two rows alike; every unit against all before it."""
    import re

    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]+", lambda m: m[0].lower(), x)).strip(" ")
    cut = lambda line: re.sub(r"([.!?][\x20\x09\x0B-\x0D]+)", r"\1\n", line).split("\n")
    texts = [[cut(line) for line in (t or "").split("\n")] for _, t in docs]
    counts, seen, later = Counter(), set(), {}
    for d, lines in enumerate(texts):
        for li, parts in enumerate(lines):
            norms = [norm(p) for p in parts if norm(p)]
            for k, x in ([(-1, " ".join(norms))] if len(norms) > 1 else []) + list(enumerate(norms)):
                counts[x] += 1
                later[d, li, k] = (x, x in seen)
                seen.add(x)
    out = []
    for d, (doc_id, _) in enumerate(docs):
        flat, at = [], 0  # line, start, end, bytes, whole, repeated, shared
        for li, parts in enumerate(texts[d]):
            n = sum(1 for p in parts if norm(p))
            k = 0
            for p in parts:
                if norm(p):
                    own, line = later[d, li, k], later[d, li, 0 if n == 1 else -1]
                    flat.append([li, at, at + len(p), len(norm(p).encode()), line[1], own[1] or line[1], counts[own[0]] > 1 or counts[line[0]] > 1])
                    k += 1
                at += len(p)
            at += 1

        def runs(flags):
            got, size = [], 0
            for f, flag in zip(flat, flags):
                size = size + f[3] if flag else 0
                got.append(size)
            for i in range(len(got) - 2, -1, -1):
                if flags[i] and flags[i + 1]:
                    got[i] = got[i + 1]
            return got

        gone = [f[4] or (f[5] and n >= min_run) for f, n in zip(flat, runs([f[5] for f in flat]))]
        spans = []
        for i, (f, g) in enumerate(zip(flat, gone)):
            if g and i and gone[i - 1] and flat[i - 1][0] == f[0]:
                spans[-1][1] = f[2]
            elif g:
                spans.append([f[1], f[2]])
        kept, starts = [], {f[1]: g for f, g in zip(flat, gone)}
        at = 0
        for li, parts in enumerate(texts[d]):
            mine = [g for f, g in zip(flat, gone) if f[0] == li]
            left = ""
            for p in parts:
                left += "" if norm(p) and starts[at] else p
                at += len(p)
            at += 1
            if not mine or not all(mine):
                kept.append(left)
        out.append((doc_id, len(flat), sum(gone), " ".join(f"{a}-{z}" for a, z in spans), max(runs(gone), default=0),
                    max(runs([f[6] for f in flat]), default=0), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def op10(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    hostile = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", hostile), (1, "assistant", hostile)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in convs.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


def crc_mod(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod

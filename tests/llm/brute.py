"""Plain versions of the operators, to compare with on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text) if text else []


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring_dedup(docs, width):
    """docs: {doc_id: text}. {doc_id: (n_words, n_removed, sha256)}."""
    split = {d: words(t) for d, t in docs.items()}
    first = {}
    for d in sorted(split):
        for k in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][k : k + width]), (d, k))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (d, k):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_dedup(docs, width):
    """docs: list of (doc_id, text). List of (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(b[k : k + width] for _, b in raw for k in range(len(b) - width + 1))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, shingle=4):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(docs, max_bits=4):
    """docs: {doc_id: text}. {doc_id: (fingerprint, component)}."""
    fps = {d: fingerprint(t) for d, t in docs.items()}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= max_bits]
    found = roots(ids, links)
    return {d: (f"{fps[d]:016x}", found[d]) for d in ids}


def near_vectors(vectors, threshold):
    """vectors: {vec_id: list or None}. {vec_id: (n_links, component)}."""
    ok = {v: np.array(x, dtype=float) for v, x in vectors.items() if x and None not in x and np.isfinite(np.array(x, dtype=float)).all() and any(x)}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= threshold]
    count = Counter(x for pair in links for x in pair)
    found = roots(list(vectors), links)
    return {v: (count[v], found[v]) for v in vectors}

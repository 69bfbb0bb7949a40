"""Brute-force versions of the contracts, in plain Python over small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    if not a and not b:
        return 1.0
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def classes(nodes, links):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicate_classes(texts, threshold=0.8):
    """doc_id -> smallest doc_id of its class, comparing all pairs that share a shingle."""
    bags = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, bag in bags.items():
        for s in bag or [()]:
            holders[s].append(d)
    pairs = {(a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1:]}
    return classes(texts, [p for p in pairs if overlap(bags[p[0]], bags[p[1]]) >= threshold])


def remove_repeats(texts, size=200, keep="none"):
    """doc_id -> (n_bytes, n_removed, n_spans, kept) by listing every window."""
    raws = {d: (t or "").encode() for d, t in sorted(texts.items())}
    count, seen = Counter(r[i:i + size] for r in raws.values() for i in range(len(r) - size + 1)), set()
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            w = r[i:i + size]
            if count[w] > 1 and (keep == "none" or w in seen):
                gone[i:i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out[d] = (len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def mix_targets(sizes, epochs=3):
    """source -> target: shares by weight, excess over the cap reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: float(epochs * sizes[s]) for s in capped}
        capped |= over


def vector_links(rows, cosine=0.93):
    """vec_id -> (n_links, component) of (vec_id, vector, label) rows with distinct ids."""
    def valid(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if valid(v, label)]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in good}
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[n + 1:]
             if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= cosine]
    count = Counter(x for p in links for x in p)
    part = classes([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], part[r[0]]) for r in rows}


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    """kind:start:end of the base kinds, by kind and start."""
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out

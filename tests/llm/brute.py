"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def labels_of(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in edges:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def jaccard(docs):
    """[(id, text)] to {row: (class id, copies, links)} by comparing all that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    both = Counter((a, b) for rows in by.values() for x, a in enumerate(rows) for b in rows[x + 1 :])
    edges = [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    links, copies = Counter(), Counter(s for s in sets if s)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    group = labels_of(len(docs), edges)
    least = {}
    for i, g in enumerate(group):
        key = (docs[i][0] is not None, docs[i][0])
        least[g] = min(least.get(g, key), key)
    return [(docs[i][0], least[group[i]][1], copies[sets[i]] if sets[i] else 1, links[i]) for i in range(len(docs))]


def repeated(docs, length=200):
    """[(id, text)] to [(id, bytes, removed, runs, sha256 of the rest)]."""
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(docs, data, strict=True):
        cover = np.zeros(len(d) + 1, np.int64)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length - len(d) - 1 if p + length == len(d) else p + length] -= 1
        gone = np.cumsum(cover)[: len(d)] > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(docs):
    enc = encoding()
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    return out


def cosine(rows, threshold=0.9):
    """[(id, vector)] to [(id, links, component, kept)]."""
    unit = []
    for _, v in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
        n = 0 if v is None or not np.isfinite(v).all() else np.sqrt((v * v).sum())
        unit.append(v / n if n else None)
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    links = Counter(i for e in edges for i in e)
    group = labels_of(len(rows), edges)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    return [(i, links[k], least[group[k]], i == least[group[k]]) for k, (i, _) in enumerate(rows)]


def base_quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    return out


def licenses(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = []
    for i, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        out.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def cost(capacity):
    return 64.0 + capacity + capacity * capacity / 65536.0


def least_cost(lengths):
    """A bound from below: a piece of n tokens lies in a sequence of n or more."""
    return sum(n * min(cost(c) / c for c in (1024, 2048, 4096, 8192) if c >= n) for n in lengths)


def entropy(ids):
    n = len(ids)
    return -sum(k / n * math.log2(k / n) for k in Counter(ids).values()) / math.log2(n) if n > 1 else 1.0


def noisy_or(text, leak, bias, weights):
    """A document's score and its sentences with evidence, from the definition: every word's
    different strings count once, every word as often as it stands there."""
    clean, found = 1 - 1 / (1 + math.exp(-leak)), []
    for m in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
        s, any_ = 0.0, False
        for w in re.findall(r"\w+", m[0].lower()):
            w = "^" + w + "$"
            parts = {w, *[w[:k] for k in range(4, 8)], *[w[i : i + k] for k in (4, 5) for i in range(len(w) - k + 1)]}
            for g in parts & weights.keys():
                s, any_ = s + weights[g], True
        if any_ and s:
            p = 1 / (1 + math.exp(-(bias + s)))
            clean *= 1 - p
            found.append((m.start(), m.end(), p))
    return 1 - clean, found

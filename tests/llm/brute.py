"""Plain versions of the training-data operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def jaccard_links(docs, threshold=0.8):
    """(class_id, n_links) per (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return [(min(groups[root(k)]), links[k]) for k in range(len(sets))]


def repeats(docs, length=100):
    """(n_bytes, n_removed, n_spans, sha256, kept bytes) by doc_id."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            part = raw[p : p + length]
            if part in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def contamination(text, items, window=10):
    """(n_words, n_hit, items)."""
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        own = words(t)
        n = min(window, len(own))
        shapes = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in shapes:
                hit[k : k + n] = [True] * n
                if item is not None:
                    found.add(item)
    return len(w), sum(hit), sorted(found)


def judge(url, rules):
    """(host, path, rule, verdict)."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.encode().translate(LOWER).decode()
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        p = slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else "allow"


def pieces(tokenizer, docs, capacity=2048, end=0):
    import numpy as np

    out = []
    for i, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        for n, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((i, n, s, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)

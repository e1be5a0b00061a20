"""Plain versions of the corpus operators for small inputs, one row at a time."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import xxhash

LETTERS = str.isalpha
M32 = (1 << 32) - 1


def grams(text, bits):
    """Hashed 2- and 3-gram counts of the letters, with one blank after each word."""
    low, kept = (text or "").lower() + " ", []
    for i, ch in enumerate(low):
        if ch.isalpha():
            kept.append((ord(ch), True))
        elif i and low[i - 1].isalpha():
            kept.append((32, False))
    out = {}
    for (x, _), (y, _) in zip(kept, kept[1:]):
        h = ((x * 0x9E3779B1 & M32) ^ ((y * 0x85EBCA6B & M32) + 0x7F4A7C15 & M32)) >> (32 - bits)
        out[h] = out.get(h, 0) + 1
    for (x, _), (y, inner), (z, _) in zip(kept, kept[1:], kept[2:]):
        if inner:
            h = ((x * 0x9E3779B1) + ((y * 0x85EBCA6B & M32) ^ ((z * 0xC2B2AE35 & M32) >> 3)) * 0x27D4EB2F & M32) >> (32 - bits)
            out[h] = out.get(h, 0) + 1
    return out


def nearest(text, idf, langs, centroids, bits):
    """(language, cosine) of the nearest centroid; und and 0 without a letter."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    v = {g: math.log1p(n) * float(idf[g]) for g, n in grams(text, bits).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    sims = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in centroids]
    return langs[int(np.argmax(sims))], max(0.0, min(1.0, max(sims)))


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def sampled(rows, seed=17):
    """{row: copies} of (row, source, size, place), with the places in the order in which a source's documents lie."""
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            target[s] = Fraction(3 * sizes[s])
            rest -= target[s]
            free.discard(s)
    out = {}
    for s in names:
        digest = hashlib.sha256(f"{seed}:{'' if s is None else '=' + s}".encode()).digest()
        at = Fraction(int.from_bytes(digest[:7], "big"), 1 << 56)
        each = target[s] / sizes[s] if sizes[s] else Fraction(0)
        for row, _, _, _ in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            before, at = math.floor(at), at + each
            out[row] = math.floor(at) - before
    return out

"""Plain versions of the operators' contracts, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

SPACED = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, length=35):
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for d, w in words:
        bad = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                bad[i : i + length] = [True] * length
        out.append((d, len(w), sum(bad), sha(" ".join(x for x, b in zip(w, bad, strict=True) if not b))))
    return out


def fingerprint(text):
    w = SPACED.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Least index of each print's group."""
    x, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def contamination(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = LETTERS.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in docs:
        w, hit, found = LETTERS.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def near(docs, items, slop):
    """(document, item) where one stretch of as many words as the item has distinct ones, and slop more, holds them all."""
    for d, t in docs:
        w = LETTERS.findall(lower(t))
        for i, x in items:
            terms = set(LETTERS.findall(lower(x)))
            n = len(terms) + slop
            if terms and any(terms <= set(w[k : k + n]) for k in range(max(1, len(w) - n + 1))):
                yield d, i


def language_model(docs):
    rows = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, [*SPACED.findall(lower(t)), None]) for d, t in docs]
    count = collections.Counter(w for _, held, ws in rows if not held for w in ws)
    n, v = sum(count.values()), len(count)
    total, kinds, gram = collections.Counter(), collections.Counter(), collections.Counter()
    for _, held, ws in rows:
        for i, w in enumerate([] if held else ws):
            gram[0 if i == 0 else ws[i - 1], w] += 1
            if i:
                gram[0 if i == 1 else ws[i - 2], ws[i - 1], w] += 1
    for g, k in gram.items():
        total[g[:-1]] += k
        kinds[g[:-1]] += 1
    spare = 0.5 * v / n / (v + 1) if n else 1.0
    out = []
    for d, held, ws in rows:
        base, score = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 0.0
        for i, w in enumerate(ws):
            p = (count[w] - 0.5) / n + spare if count[w] else spare
            before = ws[i - 2 : i] if i > 1 else [0, *ws[:i]]
            for context in (tuple(before[-1:]), tuple(before))[: len(before)]:
                if total[context]:
                    p = (gram[*context, w] + kinds[context] * p) / (total[context] + kinds[context])
            score += math.log10(p)
        out.append((d, held, len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
        return True

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def counts(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def robust_distances(x, floor, bins, share=0.75, median=5.385, settled=1e-6, most=100):
    """Squared, scaled distances of a group's vectors from its minimum covariance determinant estimate."""
    x, floor = np.array(x, float), np.diag(floor)

    def spread(centre, scatter):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d)

    def binned(d2):
        return np.floor(np.log(d2 + 1e-6) * bins)

    starts = []
    for centre, scatter in ((np.array([np.sort(np.floor(c * 100 + 0.5))[(len(c) + 1) // 2 - 1] / 100 for c in x.T]), floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        det = np.inf
        for _ in range(most):
            b, weight, before = binned(spread(centre, scatter)), np.zeros(len(x)), 0
            for k in np.unique(b):
                n = (b == k).sum()
                weight[b == k] = min(1.0, max(0.0, (share * len(x) - before) / n))
                before += n
            weight /= weight.sum()
            centre = weight @ x
            scatter = (x - centre).T @ ((x - centre) * weight[:, None]) + floor
            det, was = np.log(np.linalg.det(scatter)), det
            if was - det <= settled:
                break
        starts.append((np.log(np.linalg.det(scatter)), len(starts), centre, scatter))
    _, _, centre, scatter = min(starts)
    d2 = spread(centre, scatter)
    edge = np.sort(binned(d2))[int(np.ceil(share * len(x))) - 1]
    return d2 / max(1.0, np.exp((edge + 1) / bins) / median)

"""Plain Python versions of the operators, over lists of rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base(text):
    ws = words(text)
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered), failed


def order(rows):
    """By id, null last; rows alike keep their place."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))


def exact(rows):
    """(id, text) -> sorted list of (id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = sorted(order(members), key=lambda m: -len(m[1]))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, best[0][0], len(members), at == 0, sha) for at, (i, _) in enumerate(best)]
    return out


def fingerprint(text):
    ws = [w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """(id, text) -> {row index: (hex, component id)}."""
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        ids[find(a)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(f"{fps[a]:016x}", least[find(a)]) for a in range(len(rows))]


def edits(a, b):
    """Word edit distance, exact up to 1 (2 stands for more)."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    if len(b) == len(a) + 1:
        return 1 if any(b[:i] + b[i + 1:] == a for i in range(len(b))) else 2
    return 2


def dedup_lines(rows, least=5):
    """(id, text) -> {(id, text): (text, n_lines, n_exact, n_near, emptied)}; rows alike are one document."""
    seen, out = [], {}
    done = set()
    for i, t in order(sorted(set(rows), key=lambda r: str(r[1]))):
        if t is None:
            out[i, t] = (None, 0, 0, 0, False)
            continue
        kept, exact_n, near_n = [], 0, 0
        for line in t.split("\n"):
            ws = words(line)
            if not ws:
                kept.append(line)
                continue
            if tuple(ws) in done:
                exact_n += 1
                continue
            done.add(tuple(ws))
            if len(ws) < least:
                kept.append(line)
                continue
            if any(edits(ws, s) <= 1 for s in seen):
                near_n += 1
            else:
                kept.append(line)
            seen.append(ws)
        text = "\n".join(kept)
        out[i, t] = (text, len(t.split("\n")), exact_n, near_n, exact_n + near_n > 0 and not words(text))
    return out


def uniform(*parts):
    return int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 2 ** 52


def copies(rows, weights=None, alpha=0.5, epochs=1.0, seed=9):
    """(id, source) -> number of copies of each row."""
    n = Counter(s for _, s in rows)
    w = {s: weights.get(s, 0.0) if weights is not None else c ** alpha for s, c in n.items()}
    total = sum(w.values())
    out = []
    for i, s in rows:
        rate = epochs * len(rows) / total * w[s] / n[s] if total else 0.0
        draws = max(1, math.ceil(rate / 16))
        k = 0
        for d in range(1, draws + 1):
            u, p = uniform(seed, i, d), math.exp(-rate / draws)
            c, at = p, 0
            while c <= u and at < 99:
                at += 1
                p *= rate / draws / at
                c += p
            k += at
        out.append(k)
    return out


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in pieces)
        n += 1
    return n

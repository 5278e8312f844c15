"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(t):
    return WORD.findall((t or "").encode().lower().decode())


def quality_counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def components(docs, k, num, den):
    """doc_id -> (set size, component); docs are (doc_id, text) with distinct ids."""
    def shingled(t):
        w = words(t)
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset(
            [tuple(w)] if w else [])
    sets = {d: shingled(t) for d, t in docs}
    held = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in held[g] if e < d).items():
            if den * both >= num * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, n=50):
    """doc_id -> (bytes, removed, spans, hash of the rest)."""
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first.setdefault(b[i:i + n], d) < d:
                m[i:i + n] = b"\1" * n
        out[d] = (len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])),
                  sha(bytes(x for x, y in zip(b, m) if not y)))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    """doc_id -> (lines, dropped, hash of the rest)."""
    ends = "\t\n\x0b\x0c\r "
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[x.strip(ends).translate(lower)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(k := x.strip(ends).translate(lower)) >= min_chars
                                         and len(held[k]) >= min_docs and max(held[k]) != d)]
        out[d] = (len(lines), len(lines) - len(keep), sha("\n".join(keep)))
    return out

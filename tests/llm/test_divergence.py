"""The source divergence audit against dense counting in plain Python."""

import re
from collections import Counter

import pytest
from clausewise.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    """All groups, all terms, all pairs; rows are (text, lang, source)."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    docs, counts = Counter(), {}
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g for g, _ in counts}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= min_docs)
        groups = {s: [c[t] for t in kept] for (g, s), c in counts.items() if g == lang}
        total = [sum(c) for c in zip(*groups.values())]
        share = lambda c: [1 + 10 ** 9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c]
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s, mine in p.items():
            pairs = [(sum(abs(a - b) for a, b in zip(mine, other)), o) for o, other in p.items() if o != s]
            terms = [(a - b, t) for a, b, t, n in zip(mine, q, kept, groups[s]) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def got(df, **options):
    cols = ("lang", "source", "part", "item", "value", "rank")
    return sorted(tuple(r[c] for c in cols) for r in source_divergence.divergence(df, **options).collect())


@pytest.mark.parametrize("groups,terms", [(200, 1024), (2, 7)])
def test_divergence_is_exact_in_any_cells(docs, rows, groups, terms):
    want = brute([(r[1], r[2], r[3]) for r in rows], 5, 4)
    assert any(r[2] == "term" for r in want) and any(r[2] == "pair" and r[4] for r in want)
    assert got(docs, min_docs=5, top_terms=4, block_groups=groups, block_terms=terms) == want


def test_odd_rows(odd):
    """Null ids, texts, languages and sources, repeated rows, clashing names."""
    want = brute([(r["text"], r["lang"], r["source"]) for r in odd.collect()], 1, 50)
    assert got(odd, min_docs=1, block_groups=1, block_terms=50) == want


def test_ties_and_languages_without_terms(spark):
    rows = [("b a", "x", "s"), ("b a", "x", "t"), ("a b", "x", "u"), ("1 2", "y", "s"), ("", "y", "t"), (None, "z", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(df, min_docs=1) == brute(rows, 1, 50)
    assert [r[3:] for r in got(df, min_docs=1) if r[:3] == ("y", "s", "pair")] == [("t", 0, 1)]


def test_empty(empty):
    assert got(empty) == []


def test_tasks_give_out_what_they_hold():
    import pyarrow as pa

    texts = [" ".join(f"w{chr(97 + i % 26) * (1 + i // 26 % 9)}{'xyz'[j]}" for j in range(3)).encode() for i in range(500)]
    long = " ".join(["wordé"] * 400_000).encode()
    batch = pa.record_batch({"lang": ["a"] * 501, "source": ["s"] * 501, "text": [*texts, long]})
    n = Counter()
    for b in source_divergence._count([batch]):
        for term, k in zip(b.column("term").to_pylist(), b.column("n").to_pylist()):
            n[term] += k
    assert n["wordé"] == 400_000 and sum(n.values()) == 400_000 + 1500


def test_shares_are_whole_numbers(spark):
    from pyspark.sql import functions as F

    rows = [(1, 3), (5, 9_000_000_000_000_001), (9_000_000_000_000_000, 9_000_000_000_000_001), (7, 7)]
    df = spark.createDataFrame(rows, "a long, b long")
    for a, b, p in df.select("a", "b", source_divergence.share(F.col("a"), F.col("b"))).collect():
        assert p == 1 + 10 ** 9 * a // b

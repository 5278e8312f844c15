from collections import defaultdict

import numpy as np
import pytest
from clausewise.llm import compact_windows, exact_dedup, jaccard_join, line_dedup, runlength_index
from pyspark.sql import functions as F

from . import brute


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, batches=3, keys_per_shard=40).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, a = groups[r[1] or ""], got[r[0]]
        assert (a["keep_id"], a["group_size"], a["kept"], a["text_sha256"]) == (
            max(g), len(g), r[0] == max(g), brute.sha(r[1] or ""))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_fuse_filter_has_no_false_negative(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2 ** 63, n).astype(np.uint64))
    blob = exact_dedup.build_filter(keys)
    assert exact_dedup.in_filter(blob, keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2 ** 63, 20_000).astype(np.uint64)
    assert exact_dedup.in_filter(blob, others).mean() < 0.02
    assert len(blob) < 2 * n + 400


def test_line_dedup(docs, rows):
    want = brute.line_dedup([r[:2] for r in rows])
    for batches, fanout in ((1, 4), (4, 2)):
        got = line_dedup.line_dedup(docs, batches=batches, fanout=fanout)
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"] or "")) for r in got.collect()} == want
    assert any(w[1] for w in want.values())


def test_runlength_index(docs, rows):
    want = brute.repeats([r[:2] for r in rows])
    got = {r["doc_id"]: r for r in runlength_index.remove_repeats(docs).collect()}
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for d, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 20
    for r in got.values():
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_segments_split_for_frequent_anchors(docs, rows, monkeypatch):
    """Every anchor counts as frequent: all windows go one by one, with the same result."""
    shared = runlength_index._shared_anchors
    monkeypatch.setattr(runlength_index, "_shared_anchors", lambda *a: shared(*a[:-1], 2))
    got = runlength_index.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.repeats([r[:2] for r in rows])


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_owners_of_many_variants(rounds):
    r = np.random.default_rng(2)
    base = r.integers(97, 105, 600).astype(np.uint8)
    docs = []
    for _ in range(80):
        x = base.copy()
        x[r.integers(0, 600, r.integers(0, 6))] = 122
        a = r.integers(0, 300)
        docs.append(x[a:a + r.integers(60, 300)].tobytes().decode())
    anchor, text, first, count = runlength_index.segments(docs, 50)
    found = {}
    for a, d, f, c in zip(anchor.tolist(), text.tolist(), first.tolist(), count.tolist()):
        key = (a, docs[d].encode()[f:f + c + 49])
        found[key] = min(found.get(key, 99), d)
    data = np.frombuffer(b"".join(s for _, s in found), np.uint8)
    end = np.cumsum([len(s) for _, s in found])
    begin = end - [len(s) for _, s in found]
    owner = runlength_index.owners(np.array([a for a, _ in found], np.uint64), np.array(list(found.values())),
                                   data, begin, end, 50, rounds)
    least = {}
    for (_, s), d in found.items():
        for i in range(len(s) - 49):
            least[s[i:i + 50]] = min(least.get(s[i:i + 50], 99), d)
    for j, (_, s) in enumerate(found):
        assert owner[begin[j]:end[j] - 49].tolist() == [least[s[i:i + 50]] for i in range(len(s) - 49)]


def test_suffix_array():
    for text in (b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"abracadabra" * 9, bytes(np.random.default_rng(1).integers(97, 99, 500))):
        order = runlength_index.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_jaccard_components(docs, rows):
    for k, num in ((4, 85), (5, 80)):
        want = brute.components([r[:2] for r in rows], k, num, 100)
        got = jaccard_join.jaccard_components(docs, jaccard_join.Rule(k, num, 100))
        assert {r["_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    kept = jaccard_join.drop_near_copies(docs)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_linked_sets_share_a_key():
    """Sets of every size at exactly the least overlap, differences dealt at random."""
    r = np.random.default_rng(3)
    for rule in (jaccard_join.Rule(4, 85), jaccard_join.Rule(5, 80)):
        for n in [*range(2, 40), 75, 160, 400]:
            for m in (n, rule.partners(n)[-1]):
                for _ in range(20):
                    pool = np.unique(r.integers(0, 2 ** 63, n + m).astype(np.uint64))
                    r.shuffle(pool)
                    both = rule.overlap(n, m)
                    if both > min(n, m):
                        continue
                    a, b = np.sort(pool[:n]), np.sort(pool[n - both:n - both + m])
                    assert (a.tolist() == b.tolist()) or np.isin(rule.keys(a), rule.keys(b)).any(), (n, m)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_compact_windows_are_the_cartesian_trees_nodes():
    token = np.random.default_rng(4).integers(0, 40, 300).astype(np.uint64)
    n = np.array([120, 5, 0, 175])
    key, doc, c, start, size = compact_windows.windows(token, n, 20, 1)
    from clausewise.llm.shingles import mix
    seen = {(int(d), i): (int(k), int(p)) for k, d, p, s, z in zip(key, doc, c, start, size) for i in range(s, s + z)}
    at = np.cumsum(n) - n
    for d in range(4):
        h = mix(token[at[d]:at[d] + n[d]], 41)
        for i in range(n[d] - 19):
            assert seen.pop((d, i)) == (int(h[i:i + 20].min()), i + int(h[i:i + 20].argmin()))
    assert not seen


def test_passages(docs, rows):
    texts = {r[0]: brute.words(r[1]) for r in rows}
    got = compact_windows.passages(docs).collect()
    found = defaultdict(set)
    for r in got:
        assert r["first_id"] < r["_id"] and r["n_words"] >= 15
        found[r["_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
        a, b = (texts[r[d]][r[w]:][:r["n_words"]] for d, w in (("_id", "start_word"), ("first_id", "first_word")))
        p, q = ({tuple(x[i:i + 5]) for i in range(len(a) - 4)} for x in (a, b))
        assert len(p & q) >= 0.5 * len(p | q) and a[:5] == b[:5] and a[-5:] == b[-5:]
    first, want = {}, defaultdict(set)
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            w = tuple(texts[d][i:i + 50])
            if first.setdefault(w, d) < d:
                want[d].update(range(i, i + 50))
    missed = sum(len(want[d] - found[d]) for d in want)
    assert set(want) <= set(found) and missed <= 0.02 * sum(map(len, want.values()))
    # An edited copy is found too, around its edit.
    assert any(len(found[d]) > 100 and "edit0" in texts[d] for d in texts)


def test_drop_passages(docs, rows):
    got = {r["doc_id"]: r for r in compact_windows.drop_passages(docs).collect()}
    hit = {r["_id"] for r in compact_windows.passages(docs).collect()}
    for r in rows:
        if r[0] not in hit:
            assert tuple(got[r[0]]) == r
        elif r[0] in got:
            assert got[r[0]]["n_chars"] == len(got[r[0]]["text"]) < len(r[1])
    third = [r for r in rows if r[0] == 1014][0]
    assert got[1014]["text"] == third[1].split("\n")[1]


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, jaccard_join.drop_near_copies, compact_windows.drop_passages])
def test_odd_rows_keep_their_columns(odd, empty, drop):
    got = drop(odd)
    assert got.columns == odd.columns
    back = got.collect()
    assert all(r["_id"] == 0 and r["kept"] == 4 and r["comp"] == 11 for r in back) and len(back) >= 12
    assert drop(empty).collect() == []


def test_odd_rows_of_the_others(odd, empty):
    got = line_dedup.line_dedup(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"] and got.count() == odd.count()
    assert {r["doc_id"]: r["n_bytes"] for r in runlength_index.remove_repeats(odd).collect()}[None] > 100
    twice = [r for r in runlength_index.remove_repeats(odd).collect() if r["doc_id"] == 10]
    assert len(twice) == 3 and len({bytes(r["kept"]) for r in twice}) == 1
    for f in (line_dedup.line_dedup, runlength_index.remove_repeats, exact_dedup.exact_dedup,
              jaccard_join.jaccard_components, compact_windows.passages):
        assert f(empty).collect() == []
    one = jaccard_join.jaccard_components(odd).collect()
    assert {r["component_id"] for r in one if r["n_shingles"] == 0 and r["_id"] in (0, 1, 2)} == {0, 1, 2}


def near_passages(texts, others):
    """Whether a 50-word passage of texts reaches 0.8 with one of others at any place."""
    def sets(t):
        return [frozenset(tuple(t[j:j + 5]) for j in range(i, i + 46)) for i in range(len(t) - 49)]
    return any(5 * len(p & q) >= 4 * len(p | q) for p in sets(texts) for q in sets(others))


def test_every_edited_passage_is_proposed(spark):
    """One word replaced, put in or left out anywhere in 50 words: all that brute force finds."""
    r = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    rows, want = [], set()
    for i in range(150):
        a = word(50)
        at, kind = 20 + i % 10 if i < 100 else int(r.integers(0, 50)), i % 3
        b = [*a[:at], *word(1)[:kind != 2], *a[at + (kind != 1):]]
        a, b = word(9) + a + word(9), word(7) + b + word(7)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        if near_passages(b, a):
            want.add((1000 + i, i))
    got = {(r["_id"], r["first_id"]) for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 80 and got == want


@pytest.mark.parametrize("others", [1, 200])
def test_a_part_of_a_passage_in_between_hides_nothing(spark, others):
    """Smaller documents hold only 36 words of the passage, so the first of them is no holder."""
    r = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    passage = word(56)
    rows = [(i, word(30) + passage[10:46] + word(30)) for i in range(others)]
    rows += [(1000, word(40) + passage + word(20)), (1001, word(20) + passage + word(40))]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    for parts in (1, 4):
        got = compact_windows.passages(d.repartition(parts)).collect()
        assert {(r["_id"], r["first_id"]) for r in got} == {(1001, 1000)}
        covered = {j for r in got for j in range(r["start_word"], r["start_word"] + r["n_words"])}
        assert covered == set(range(20, 76))


@pytest.mark.parametrize("kind", [0, 2])
def test_edited_passages_of_grams_that_very_many_hold(spark, kind):
    """All hold the first words of 80 pairs of edited copies; the smallest document has them alone."""
    r = np.random.default_rng(10 + kind)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    head, rows, want = word(26), [], set()
    rows.append((0, " ".join(word(60) + head + word(60))))
    for i in range(1, 81):
        rest = word(24)
        a = head + word(1) + rest
        b = head + word(1)[:kind != 2] + rest  # a word replaced or left out
        if i % 4 == 0:  # the long run behind the edit
            a, b = a[::-1], b[::-1]
        a, b = word(60) + a + word(60), word(55) + b + word(62)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        if near_passages(b, a):
            want.add((1000 + i, i))
    assert len(want) == 80
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(x["_id"], x["first_id"]) for x in compact_windows.passages(d).collect()} == want


def test_keys_of_frequent_grams_meet_in_turns(spark, monkeypatch):
    """Many passages: no turn has more keys than twice the texts, and turns find what one turn does."""
    assert compact_windows.edit_turns(0, 0, 46, 5, 5) == 1
    need = compact_windows.edit_turns(169_631, 53_000_000, 46, 5, 5)
    assert 1 < need == -(-169_631 * 120 * 21 // 106_000_000)
    assert compact_windows.edit_turns(1_696_310, 530_000_000, 46, 5, 5) == need
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    head, rows = word(26), []
    for i in range(75):
        a = head + word(1) + word(24)
        b = a[:26] + word(1) + a[27:]
        rows += [(i, " ".join(word(60) + a + word(60))), (1000 + i, " ".join(word(55) + b + word(62)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = sorted(compact_windows.passages(d).collect())
    turns = []
    monkeypatch.setattr(compact_windows, "edit_turns", lambda *a: turns.append(a) or 3)
    assert once and sorted(compact_windows.passages(d).collect()) == once and turns[0][0] >= 150


@pytest.mark.parametrize("kind", [0, 2])
def test_passages_of_frequent_grams_that_repeat_shingles(spark, kind):
    """Edited copies that say some words twice: no key of runs tells them, their sets do."""
    r = np.random.default_rng(20 + kind)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    head, rows, want = word(26), [], set()
    rows.append((0, " ".join(word(60) + head + word(60))))
    for i in range(1, 81):
        rest = word(5) * 2 + word(14)
        a = head + word(1) + rest
        b = head + word(1)[:kind != 2] + rest
        if i % 4 == 0:
            a, b = a[::-1], b[::-1]
        again = word(20) + b if i % 5 == 0 else []  # twice in one document
        a, b = word(60) + a + word(60), word(55) + b + again + word(62)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        if near_passages(b, a):
            want.add((1000 + i, i))
    assert len(want) > 70
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = compact_windows.passages(d).collect()
    assert {(x["_id"], x["first_id"]) for x in got} == want
    for i in range(1005, 1081, 5):  # both places of a passage that a document says twice
        at = [x["start_word"] for x in got if x["_id"] == i]
        assert not at or max(at) - min(at) > 50


def test_sets_in_turns_find_the_smallest_document():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2 ** 63, 60).astype(np.uint64)
    token = np.concatenate([r.choice(pool, 46 if i % 3 else 20) for i in range(400)] + [np.resize(pool[i:i + 7], 60) for i in range(20)])
    at = np.arange(0, len(token) - 46, 5)
    uses = np.zeros(1 << 16, np.int64)
    doc, sets = at // 40, [frozenset(token[i:i + 46].tolist()) for i in at]
    keys, owner, rows = compact_windows.prefix(token, at, 46, uses, 80, 100)
    said = {"docs": doc, "starts": at, "asks": np.array([len(s) < 46 for s in sets])}
    got = {}
    for turn in range(3):
        pdf = compact_windows._packed(keys, owner, said, 4, turn, 3, rows)
        for _, part in pdf.groupby("bucket"):
            for x in compact_windows._similar(part, 46, 80, 100).itertuples():
                got[x.at] = min(got.get(x.at, x.first), x.first)
    want = {}
    for i, a in enumerate(sets):
        like = [doc[j] for j, b in enumerate(sets) if doc[j] < doc[i] and 5 * len(a & b) >= 4 * len(a | b)]
        if like:
            want[at[i]] = min(like)
    assert want and got == want


def test_edited_passages_that_say_the_same_over_and_over(spark):
    """Periodic texts with up to three edits each: all that brute force finds, in any turn of the period."""
    r = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
    rows, want = [], set()
    for i in range(60):
        p = int(r.integers(5, 45))
        base = (word(p) * 12)[:int(r.integers(55, 90))]

        def edited():
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                j = int(r.integers(0, len(t)))
                t[j:j + int(r.integers(0, 2))] = word(int(r.integers(0, 2)))
            return word(3) + t[int(r.integers(0, max(1, min(p, len(t) - 52)))):] + word(3)
        a, b = edited(), edited()
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        if near_passages(b, a):
            want.add((1000 + i, i))
    got = {(x["_id"], x["first_id"]) for x in compact_windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 20 and got == want

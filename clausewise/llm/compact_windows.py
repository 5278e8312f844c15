"""Near-duplicate passages by compact windows.

Tokens are hashed word shingles. Two passages of the similarity num/den share a run of
tokens (``shared_run``: 21, or 25 words, of 50 words at 0.8 with distinct shingles). Under a
hash function the Cartesian tree of a document's grams, three quarters of such a run each,
groups its subsequences by their smallest hash: the node of a gram stands for all runs that
reach from it no further than to a smaller one. These nodes are the compact windows; over
runs of one length they are starts with the same leftmost minimum, found by sliding minima
over whole batches. A shared run has one smallest gram, so the windows of both passages meet
under its hash: none is missed by chance. Of windows that agree in all that a passage with
the gram can hold, the smallest document's stands for all. Up to ``MOST`` others of a gram
all meet each other. Those of a gram with more meet the smallest document's, and each passage
with the gram meets the smallest document that has one of its keys: the whole passage, a run
as long as all that similar passages share, or two runs of that length around an edit. Of two
passages of distinct shingles some key is the same if and only if they are similar, so none
loses its last partner, and a key has one answer, however many have it. Passages with the gram
that repeat a shingle are known by their set of shingles: of equal sets one stands for all, and
different ones meet under each shingle that similar sets must share one of, the rarest of each
set (``prefix``), the smallest documents first until one is similar. What is proposed is
verified on the whole passages: their Jaccard similarity is at least num/den.

A passage is reported in every document but a smaller one that holds it. Null and short
texts hold none; null ids are one lowest id, rows of the same id are not compared with each
other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.common import map_texts, materialize, release, row_keys, whole_rows, whole_text
from clausewise.llm.shingles import mix, shingles, word_spans
from clausewise.operators.ordering import guard_unions, lookup_skew_safe

MAP_CHARS = 1_000_000
WINDOWS_PER_BUCKET = 250_000
MOST = 64  # contexts of a gram that all meet each other
PAIRS_AT_ONCE = 1_000_000
PASSAGES_AT_ONCE = 20_000
TOKEN_CLASSES = 1 << 16
TURN_BYTES = 16_000_000  # room of a turn of edit_keys at least
NO_FIRST = 2 ** 63 - 1  # no document is smaller than itself
SPANS = "__passages_to_drop"


def shared_run(tokens: int, k: int, num: int, den: int) -> int:
    """Tokens in a row that two passages of ``tokens`` tokens share at that similarity.

    At most ``lost`` tokens of each differ, and an edit between two shared runs costs at
    least k - 1 of them, so what is left is in so many runs at most.
    """
    lost = tokens * (den - num) // (den + num)
    return max(1, -(-(tokens - lost) // (lost // max(1, k - 1) + 1)))


def _hashes(token: np.ndarray):
    """A function of (begin, size): hashes of token[begin:begin + size]."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(token), base)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(token), pow(int(base), -1, 2 ** 64), np.uint64)]),
                         dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(token, 54) * power[:-1], dtype=np.uint64)])
    return lambda begin, size: mix((sums[begin + size] - sums[begin]) * inverse[begin] + np.uint64(size), 51)


def _spans(token: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of token[begin:begin + size]."""
    return _hashes(token)(begin, size)


def run_keys(token: np.ndarray, at: np.ndarray, tokens: int, lost: int) -> np.ndarray:
    """A row for each passage token[at:at + tokens]: all its runs of tokens - lost, by their place."""
    span = _hashes(token)
    return np.stack([mix(span(at + o, tokens - lost), 60 + o) for o in range(lost + 1)], axis=1)


def coarse_keys(token: np.ndarray, at: np.ndarray, tokens: int, lost: int, k: int) -> np.ndarray:
    """Fewer keys than edit_keys, for passages that may share one of those: half of what they share
    in one run, and a quarter behind the gap or all but a quarter in that run."""
    span, need = _hashes(token), tokens - lost
    half, little = (need + 1) // 2, need // 4
    most, out = need - little + 1, []
    for gap in range(k - 1, lost + 1):
        for place in range(lost - gap + 1):
            end = at + place + gap + need
            out += [mix(span(at + place, half) ^ mix(span(end - little, little), 57), 70 + 2 * place),
                    mix(span(at + place, most), 70 + 2 * place),
                    mix(span(at + place, little) ^ mix(span(end - half, half), 57), 71 + 2 * (place + gap)),
                    mix(span(end - most, most), 71 + 2 * (place + gap))]
    return np.array(out, np.uint64).reshape(len(out), len(at)).T


def edit_keys(token: np.ndarray, at: np.ndarray, tokens: int, lost: int, k: int) -> np.ndarray:
    """A row for each passage: all its ways to be one run, a gap of k - 1 to ``lost`` tokens, and
    another run, of tokens - lost in both.

    Passages of distinct shingles with an edit inside are similar if and only if they share such a
    pair of runs, and what holds the pair is similar to all that do. The longer run is at the same
    place in both, so the key has that place and side.
    """
    span, need = _hashes(token), tokens - lost
    out = []
    for gap in range(k - 1, lost + 1):
        for place in range(lost - gap + 1):
            for one in range(1, need):
                pair = span(at + place, one) ^ mix(span(at + place + one + gap, need - one), 57)
                side, where = (0, place) if one * 2 > need else (1, place + gap)
                out.append(mix(pair, 70 + 2 * where + side))
    return np.array(out, np.uint64).reshape(len(out), len(at)).T


def distinct_tokens(token: np.ndarray, at: np.ndarray, tokens: int) -> np.ndarray:
    """Whether the tokens of each passage are all different."""
    out = np.ones(len(at), bool)
    for some in np.array_split(np.arange(len(at)), 1 + len(at) // 20_000):
        held = np.sort(token[at[some][:, None] + np.arange(tokens)], axis=1)
        out[some] = (held[:, 1:] != held[:, :-1]).all(axis=1)
    return out


def _rows(token: np.ndarray, at: np.ndarray, tokens: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The tokens of each passage in a row, sorted, for some passages at a time."""
    for begin in range(0, len(at), PASSAGES_AT_ONCE):
        some = slice(begin, begin + PASSAGES_AT_ONCE)
        yield some, np.sort(token[at[some][:, None] + np.arange(tokens)], axis=1)


def _first(rows: np.ndarray) -> np.ndarray:
    """Whether a value of sorted rows is the first of its kind in its row."""
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return new


def repeating(token: np.ndarray, n: np.ndarray, tokens: int) -> np.ndarray:
    """Starts, as positions in all tokens, of passages that repeat a token."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((np.arange(len(token)), token, doc))
    same = (token[order][1:] == token[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    one, two = order[:-1][same], order[1:][same]
    near = two - one < tokens
    one, two = one[near], two[near]
    first = (np.cumsum(n) - n)[doc[two]]
    last = first + n[doc[two]] - tokens
    low, high = np.maximum(two - tokens + 1, first), np.minimum(one, last) + 1
    good = high > low
    change = np.zeros(len(token) + 1, np.int64)
    np.add.at(change, low[good], 1)
    np.add.at(change, high[good], -1)
    return np.flatnonzero(np.cumsum(change)[:-1] > 0)


def set_keys(token: np.ndarray, at: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each passage's set of tokens, and how many they are."""
    key, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for some, rows in _rows(token, at, tokens):
        new = _first(rows)
        size[some] = new.sum(axis=1)
        key[some] = mix(np.where(new, mix(rows, 58), np.uint64(0)).sum(axis=1, dtype=np.uint64), 59)
    return key, size


def prefix(token: np.ndarray, at: np.ndarray, tokens: int, uses: np.ndarray, num: int, den: int):
    """Of each passage the tokens of which a similar set has one too: all but so many as are needed,
    the rarest first. ``uses``: how often tokens of a class of hashes occur; ties fall by hash.

    Returns tokens, passage of each, and 32 bits of each passage's tokens in a row.
    """
    keys, owner, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, tokens), "<u4")]
    for some, rows in _rows(token, at, tokens):
        sets.append((rows >> np.uint64(32)).astype("<u4"))
        new = _first(rows)
        order = np.minimum(uses[(rows & np.uint64(len(uses) - 1)).astype(np.int64)], (1 << 20) - 2).astype(np.uint64)
        order = np.sort(np.where(new, order << np.uint64(44) | rows >> np.uint64(20), np.uint64(2 ** 64 - 1)), axis=1)
        size = new.sum(axis=1)
        short = size + (num * size) // -den + 1
        row, place = np.nonzero(np.arange(tokens) < short[:, None])
        keys.append(mix(order[row, place], 56))
        owner.append(row + some.start)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(sets)


def windows(token: np.ndarray, n: np.ndarray, tokens: int, function: int):
    """Compact windows under one hash function: hash value, text, token, first start, starts.

    Token and starts are positions in the text.
    """
    h, at = mix(token, 40 + function), np.arange(len(token), dtype=np.int64)
    first = np.cumsum(n) - n
    if len(h) < tokens:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    low, step = h, 1
    while step * 2 <= tokens:
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        step *= 2
    if gap := tokens - step:
        right = low[gap:] < low[:-gap]
        at = np.where(right, at[gap:], at[:-gap])
    doc = np.repeat(np.arange(len(n)), n)[:len(at)]
    inside = np.arange(len(at)) + tokens <= (first + n)[doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    start, size = start[inside[start]], size[inside[start]]
    doc, c = doc[start], at[start]
    return h[c], doc, c - first[doc], start - first[doc], size


def _pairs(ids, c, one, other, tokens: int, gram: int) -> pd.DataFrame:
    """Candidates: all passages of a window's document that hold its gram, against the other's."""
    good = ids[one] > ids[other]
    one, other = one[good], other[good]
    return pd.DataFrame({"doc": ids[one], "first": ids[other], "shift": c[other] - c[one],
                         "low": np.maximum(c[one] - (tokens - gram), 0), "high": c[one] + 1}).astype(_FOUND)


def _collapsed(key, ids, c, context, tokens: int, gram: int):
    """Sorts windows by key, context and id; those of one context meet its smallest document.

    Returns these candidates and the windows of the smallest documents, sorted.
    """
    order = np.lexsort((c, ids, context, key))
    key, ids, c, context = key[order], ids[order], c[order], context[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    found = _pairs(ids, c, np.flatnonzero(~new), lead[~new], tokens, gram)
    own = ids == ids[lead]
    return found, (key[own], ids[own], c[own], context[own])


def _met(key, ids, c, context, tokens: int, gram: int, most: int) -> Iterator[pd.DataFrame]:
    """Candidates among windows of one key: every two contexts of a key of up to ``most``
    windows; else the smallest document, and the windows again (first is null, shift is the
    gram's place) to meet by whole passages."""
    found, (key, ids, c, context) = _collapsed(key, ids, c, context, tokens, gram)
    yield found
    order = np.lexsort((c, ids, key))
    key, ids, c = key[order], ids[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    begin, size = edge[:-1], np.diff(edge)
    lead = np.repeat(begin, size)
    hot = np.repeat(size > most, size)
    yield _pairs(ids, c, np.flatnonzero(hot), lead[hot], tokens, gram)
    yield pd.DataFrame({"doc": ids[hot], "first": None, "shift": c[hot], "low": 0, "high": 0}).astype(_FOUND)
    before = np.where(hot, 0, np.arange(len(key)) - lead)
    for rows in np.array_split(np.arange(len(key)), 1 + int(before.sum()) // PAIRS_AT_ONCE):
        yield _pairs(ids, c, np.repeat(rows, before[rows]), _ranges(lead[rows], lead[rows] + before[rows]), tokens, gram)


_PACKED = {"key": "<u8", "ids": "<i8", "c": "<i4", "context": "<u4"}
_FOUND = {"doc": "int64", "first": "Int64", "shift": "int32", "low": "int32", "high": "int32"}
_FOUND_DDL = "doc long, first long, shift int, low int, high int"


def candidates(docs: DataFrame, k: int, tokens: int, num: int, den: int) -> DataFrame:
    """(doc, first, ranges): ranges of starts with a shift at which a passage may lie.

    A batch collapses windows of one gram and one context, all that a passage with the gram
    can hold, so copies are one document for each batch. What is in a gram of more than
    ``MOST`` contexts meets by whole passages, by long runs and by pairs of runs as well, and where
    shingles repeat by sets; if two edits fit into a similar passage, pairs of runs do not tell
    all, and all contexts meet.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    run = shared_run(tokens, k, num, den)
    gram = run * 3 // 4 + 1
    lost = tokens * (den - num) // (den + num)
    most = MOST if lost < 2 * (k - 1) else 2 ** 62
    buckets = max(8, total // 6 * 2 // (run - gram + 2) // WINDOWS_PER_BUCKET)
    columns = list(_PACKED)

    def send(portion: dict) -> Iterator[pd.DataFrame]:
        token, n, _ = shingles(portion["_text"], k)
        first, grams = np.cumsum(n) - n, np.where(n >= tokens, n - gram + 1, 0)
        place = _ranges(first, first + grams)
        if not len(place):
            return
        key, doc, c, _, _ = windows(_spans(token, place, np.full(len(place), gram)), grams, run - gram + 1, 0)
        left = np.maximum(c - (tokens - gram), 0)
        right = np.minimum(c + tokens, n[doc])
        context = mix(_spans(token, first[doc] + left, right - left) + (c - left).astype(np.uint64), 53) >> np.uint64(32)
        found, kept = _collapsed(key, portion["_id"].to_numpy()[doc], c, context, tokens, gram)
        bucket = (kept[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        kept = [x[order] for x in kept]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = [(s, *[x[p:q].astype(t).tobytes() for x, t in zip(kept, _PACKED.values())], None)
                for s, (p, q) in enumerate(zip(cut, cut[1:])) if q > p]
        # Passages that repeat a token are met by their sets as well, as if their grams were frequent.
        start = repeating(token, n, tokens)
        if len(start):
            owner = np.searchsorted(np.cumsum(n), start, side="right")
            c = (start - first[owner]) // (tokens - gram + 1) * (tokens - gram + 1) + tokens - gram
            owner, c = np.unique(np.stack([owner, c]), axis=1)
            found = pd.concat([found, pd.DataFrame({"doc": portion["_id"].to_numpy()[owner], "first": NO_FIRST, "shift": c, "low": 0,
                                                    "high": 0}).astype(_FOUND)])
        if len(found):
            rows.append((int(token[0] % np.uint64(buckets)), *[None] * len(columns), _pack(found)))
        yield pd.DataFrame(rows, columns=["bucket", *columns, "found"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {c: [] for c in columns}
        for pdf in frames:
            own = pdf[pdf["found"].isna()]
            for c in columns:
                held[c] += own[c].tolist()
            yield from map(_unpack, pdf["found"].dropna())
        yield from _met(*[np.frombuffer(b"".join(held[c]), t) for c, t in _PACKED.items()], tokens, gram, most)

    def whole(portion: dict) -> Iterator[pd.DataFrame]:
        """Smallest document of a portion for each whole passage around its hot grams."""
        token, n, _ = shingles(portion["_text"], k)
        doc, found = _lists(portion["at"], ("shift",))
        c = found["shift"].to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.maximum(c - (tokens - gram), 0), np.minimum(c, n[doc] - tokens) + 1
        place = np.unique(_ranges((np.cumsum(n) - n)[doc] + low, (np.cumsum(n) - n)[doc] + np.maximum(low, high)))
        doc = np.searchsorted(np.cumsum(n), place, side="right")
        key, size = set_keys(token, place, tokens)
        key = np.where(size < tokens, key, _spans(token, place, np.full(len(place), tokens)))
        yield pd.DataFrame({"key": key.astype(np.int64).astype(str),
                            "doc": portion["doc"].to_numpy()[doc], "at": (place - (np.cumsum(n) - n)[doc])})

    def starts(portion: dict):
        """Tokens, document and start of each listed passage, and where it is in the tokens."""
        token, n, _ = shingles(portion["_text"], k)
        doc, found = _lists(portion["at"], ("at",))
        at = found["at"].to_numpy(zero_copy_only=False).astype(np.int64)
        return token, portion["doc"].to_numpy()[doc], at, at + (np.cumsum(n) - n)[doc]

    def told(portion: dict) -> Iterator[pd.DataFrame]:
        token, doc, at, place = starts(portion)
        sure = distinct_tokens(token, place, tokens)
        doc, at, place = doc[sure], at[sure], place[sure]
        coarse, runs = coarse_keys(token, place, tokens, lost, k).astype("<u8"), run_keys(token, place, tokens, lost).astype("<u8")
        yield pd.DataFrame({"doc": doc, "at": at, "runs": [x.tobytes() for x in runs], "coarse": [x.tobytes() for x in coarse]})

    def counted(portion: dict) -> Iterator[pd.DataFrame]:
        token, _, _, place = starts(portion)
        n = np.zeros(TOKEN_CLASSES, np.int64)
        for _, rows in _rows(token, place, tokens):
            n += np.bincount((rows[_first(rows)] & np.uint64(TOKEN_CLASSES - 1)).astype(np.int64), minlength=TOKEN_CLASSES)
        yield pd.DataFrame({"token": np.flatnonzero(n), "n": n[n > 0]})

    def alike(uses: np.ndarray, turn: int, turns: int, whole: bool):
        """Passages under the tokens of their prefix, ``whole`` with their sets."""
        def run(portion: dict) -> Iterator[pd.DataFrame]:
            token, doc, at, place = starts(portion)
            for begin in range(0, len(at), PASSAGES_AT_ONCE):
                d, a, p = (x[begin:begin + PASSAGES_AT_ONCE] for x in (doc, at, place))
                keys, owner, sets = prefix(token, p, tokens, uses, num, den)
                asks = _first(np.sort(sets, axis=1)).sum(axis=1) < tokens
                yield _packed(keys, owner, {"docs": d, "starts": a, "asks": asks}, buckets, turn, turns, sets if whole else None)

        return run

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _similar(pdf, tokens, num, den)

    def edited(turn: int, turns: int):
        def run(portion: dict) -> Iterator[pd.DataFrame]:
            token, doc, at, place = starts(portion)
            for begin in range(0, len(at), PASSAGES_AT_ONCE):
                d, a, p = (x[begin:begin + PASSAGES_AT_ONCE] for x in (doc, at, place))
                yield _dealt(edit_keys(token, p, tokens, lost, k), d, a, np.ones(len(a), bool), buckets, turn, turns)

        return run

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                keys = np.frombuffer(b"".join(pdf["keys"]), "<u8").reshape(len(pdf), -1)
                yield _dealt(keys, *[pdf[c].to_numpy() for c in ("doc", "at", "asks")], buckets)

    def listed(passages: DataFrame, held: DataFrame) -> DataFrame:
        """The texts of documents with a list of starts each."""
        lists = passages.groupBy("doc").agg(F.collect_list(F.struct("at")).alias("at"))
        return lists.join(held.select("doc", "_text"), "doc")

    def smallest(rows: DataFrame) -> DataFrame:
        """Smallest passage that has a key, and how many have it."""
        least = rows.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("m"), F.count(F.lit(1)).alias("n"))
        return least.select("key", "n", F.col("m.doc").alias("first"), F.col("m.at").alias("first_at"))

    def lowest(found: DataFrame) -> DataFrame:
        return found.groupBy("doc", "at").agg(F.min(F.struct("first", "first_at")).alias("m")).select("doc", "at", "m.*")

    def answered(dealt: DataFrame) -> DataFrame:
        return lowest(dealt.groupBy("bucket").applyInPandas(_answers, "doc long, at int, first long, first_at int"))

    def proposed(found: DataFrame) -> DataFrame:
        return found.select("doc", "first", (F.col("first_at") - F.col("at")).alias("shift"), F.col("at").alias("low"),
                            (F.col("at") + 1).alias("high"))

    texts = row_keys(docs).select("_id", whole_text().alias("_text"))
    rows = map_texts(texts, send, "bucket int, " + ", ".join(
        f"{c} binary" for c in columns) + ", found binary", MAP_CHARS)
    met = materialize(rows.groupBy("bucket").applyInPandas(meet, _FOUND_DDL))
    release(docs.sparkSession)
    hot = met.where("first is null").groupBy("doc").agg(F.collect_set(F.struct("shift")).alias("at"))
    # Only documents with such grams are read on, so their texts are not moved with all others again.
    held = materialize(hot.join(texts.withColumnRenamed("_id", "doc"), "doc"))
    release(docs.sparkSession)
    keys = materialize(map_texts(held, whole, "key string, doc long, at int", MAP_CHARS))
    least = smallest(keys)
    equal = lookup_skew_safe(keys, least.where("n > 1"), "key", "n", "doc", ["first", "first_at"]).where("first < doc")
    equal = materialize(proposed(equal))
    # Equal passages have the same partners, so the smallest stands for all from here on; in its own
    # document, others get its answers.
    again = materialize(lookup_skew_safe(keys, least.where("n > 1"), "key", "n", "doc", ["first", "first_at"]).where(
        "first = doc and first_at < at").select("doc", F.col("at").alias("again"), F.col("first_at").alias("at")))
    one = materialize(listed(least.select(F.col("first").alias("doc"), F.col("first_at").alias("at")), held))
    del keys, least, held  # what is read no more is freed before the next step writes
    release(docs.sparkSession)
    table = materialize(map_texts(one, told, "doc long, at int, runs binary, coarse binary", MAP_CHARS))
    by_run = materialize(answered(table.select("doc", "at", F.col("runs").alias("keys"), F.lit(True).alias("asks")).mapInPandas(
        deal, _KEYS_DDL)))
    release(docs.sparkSession)
    # A passage of distinct tokens is similar to all that have a run of it: only others ask on.
    asking = table.select("doc", "at", F.col("coarse").alias("keys")).join(
        by_run.select("doc", "at", F.lit(False).alias("asks")), ["doc", "at"], "left").fillna(True, "asks")
    live = materialize(asking.mapInPandas(deal, _KEYS_DDL).groupBy("bucket").applyInPandas(_live, "doc long, at int").distinct())
    turns, live = edit_turns(live.count(), total, tokens, lost, k), materialize(listed(live, one))
    del table, asking
    release(docs.sparkSession)
    by_edit = None
    for turn in range(turns):
        part = materialize(answered(map_texts(live, edited(turn, turns), _KEYS_DDL, MAP_CHARS)))
        by_edit = part if by_edit is None else by_edit.transform(guard_unions).unionByName(part)
        release(docs.sparkSession)
    del live
    uses = np.zeros(TOKEN_CLASSES, np.int64)
    for r in map_texts(one, counted, "token int, n long", MAP_CHARS).groupBy("token").agg(F.sum("n").alias("n")).collect():
        uses[r["token"]] = r["n"]
    release(docs.sparkSession)
    live = materialize(map_texts(one, alike(uses, 0, 1, False), _KEYS_DDL, MAP_CHARS).groupBy("bucket").applyInPandas(
        _live, "doc long, at int").distinct())
    turns, live = set_turns(live.count(), total, tokens, num, den), materialize(listed(live, one))
    del one
    release(docs.sparkSession)
    by_set = None
    for turn in range(turns):
        part = materialize(lowest(map_texts(live, alike(uses, turn, turns, True), _KEYS_DDL + ", sets binary", MAP_CHARS).groupBy(
            "bucket").applyInPandas(nearest, "doc long, at int, first long, first_at int")))
        by_set = part if by_set is None else by_set.transform(guard_unions).unionByName(part)
        release(docs.sparkSession)
    del live
    told_once = by_run.transform(guard_unions).unionByName(by_edit).unionByName(by_set)
    twice = told_once.join(again, ["doc", "at"]).select("doc", F.col("again").alias("at"), "first", "first_at")
    every = met.where("first is not null").transform(guard_unions)
    for found in (equal, proposed(by_run), proposed(lowest(by_edit)), proposed(lowest(by_set)), proposed(lowest(twice))):
        every = every.unionByName(found)
    return every.groupBy("doc", "first").agg(F.collect_list(F.struct("shift", "low", "high")).alias("ranges"))


_KEYS = {"keys": "<i8", "docs": "<i8", "starts": "<i4", "asks": "?"}
_KEYS_DDL = "bucket int, " + ", ".join(f"{c} binary" for c in _KEYS)


def edit_turns(passages: int, total: int, tokens: int, lost: int, k: int) -> int:
    """Turns in which the edit_keys of so many passages meet: those of one are twice the bytes of the
    texts (``total`` characters) at most, about as much once compressed. A passage begins at a word
    of a text, so turns are bounded."""
    ways = sum((lost - gap + 1) * (tokens - lost - 1) for gap in range(k - 1, lost + 1))
    return max(1, -(-passages * ways * sum(np.dtype(t).itemsize for t in _KEYS.values()) // (2 * max(total, TURN_BYTES))))


def set_turns(passages: int, total: int, tokens: int, num: int, den: int) -> int:
    """Turns in which passages meet by sets, bounded as edit_turns are."""
    ways = tokens + num * tokens // -den + 1
    size = sum(np.dtype(t).itemsize for t in _KEYS.values()) + 4 * tokens
    return max(1, -(-passages * ways * size // (2 * max(total, TURN_BYTES))))


def _dealt(keys: np.ndarray, doc: np.ndarray, at: np.ndarray, asks: np.ndarray, buckets: int, turn: int = 0,
           turns: int = 1) -> pd.DataFrame:
    """Keys of passages, a row of each for a passage, packed by bucket; of several turns, one's keys."""
    row = np.repeat(np.arange(len(doc)), keys.shape[1])
    return _packed(np.ascontiguousarray(keys).reshape(-1).astype(np.uint64), row, {"docs": doc, "starts": at, "asks": asks},
                   buckets, turn, turns)


def _packed(keys: np.ndarray, row: np.ndarray, said: dict, buckets: int, turn: int, turns: int,
            sets: np.ndarray | None = None) -> pd.DataFrame:
    """The same for keys with the passage of each."""
    if turns > 1:
        mine = keys % np.uint64(turns) == turn
        keys, row = keys[mine], row[mine]
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    row = row[order]
    parts = [x.astype(t) for x, t in zip((keys[order], *[said[c][row] for c in ("docs", "starts", "asks")]), _KEYS.values())]
    parts += [] if sets is None else [sets[row]]
    return pd.DataFrame([(b, *[x[p:q].tobytes() for x in parts]) for b, (p, q) in enumerate(zip(cut, cut[1:])) if q > p],
                        columns=["bucket", *_KEYS, *([] if sets is None else ["sets"])])


def _similar(pdf: pd.DataFrame, tokens: int, num: int, den: int) -> pd.DataFrame:
    """For passages of one key of which one repeats a token: the smallest document that is similar.

    Each goes through those of smaller documents in order, more at a time, until one is.
    """
    key, doc, at, asks = (np.frombuffer(b"".join(pdf[c]), t) for c, t in _KEYS.items())
    sets = np.frombuffer(b"".join(pdf["sets"]), "<u4").reshape(-1, tokens)
    order = np.lexsort((at, doc, key))
    key, doc, at, asks, sets = key[order], doc[order], at[order], asks[order], sets[order]
    size = _first(sets).sum(axis=1)
    place = np.arange(len(key))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
    next_, end = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(other, place, 0))
    found = np.full(len(key), -1)
    live, width = np.flatnonzero(next_ < end), 1
    while len(live):
        stop = np.minimum(next_[live] + width, end[live])
        for some in np.array_split(np.arange(len(live)), 1 + int((stop - next_[live]).sum()) // PAIRS_AT_ONCE):
            a = np.repeat(live[some], (stop - next_[live])[some])
            b = _ranges(next_[live][some], stop[some])
            good = (asks[a] | asks[b]) & (den * np.minimum(size[a], size[b]) >= num * np.maximum(size[a], size[b]))
            a, b = a[good], b[good]
            for few in np.array_split(np.arange(len(a)), 1 + len(a) // PASSAGES_AT_ONCE):
                like = few[_alike(sets[a[few]], sets[b[few]], num, den)]
                one, first = np.unique(a[like], return_index=True)
                unset = found[one] < 0
                found[one[unset]] = b[like][first[unset]]
        next_[live] = stop
        live, width = live[(found[live] < 0) & (next_[live] < end[live])], min(width * 2, 256)
    one = np.flatnonzero(found >= 0)
    return pd.DataFrame({"doc": doc[one], "at": at[one], "first": doc[found[one]], "first_at": at[found[one]]})


def _grouped(pdf: pd.DataFrame):
    """Document, start and asks in order of key, document and start; first of each key's, of each."""
    key, doc, at, asks = (np.frombuffer(b"".join(pdf[c]), t) for c, t in _KEYS.items())
    order = np.lexsort((at, doc, key))
    key, doc, at, asks = key[order], doc[order], at[order], asks[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return doc, at, asks, np.flatnonzero(new), np.cumsum(new) - 1


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """One smaller document of each passage that shares a key with one: the smallest of all."""
    doc, at, _, first, group = _grouped(pdf)
    first = first[group]
    larger = np.flatnonzero(doc[first] < doc)
    order = larger[np.lexsort((at[first][larger], doc[first][larger], at[larger], doc[larger]))]
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])
    one = order[new]
    return pd.DataFrame({"doc": doc[one], "at": at[one], "first": doc[first[one]], "first_at": at[first[one]]})


def _live(pdf: pd.DataFrame) -> pd.DataFrame:
    """Passages with a key that another document has too, if one of the key's asks."""
    doc, at, asks, first, group = _grouped(pdf)
    last = np.append(first[1:], len(doc)) - 1
    live = (doc[first] < doc[last]) & np.logical_or.reduceat(asks, first)
    return pd.DataFrame({"doc": doc, "at": at})[live[group]].drop_duplicates()


def _pack(found: pd.DataFrame) -> bytes:
    return np.ascontiguousarray(found.to_numpy(dtype="<i8")).tobytes()


def _unpack(blob: bytes) -> pd.DataFrame:
    found = pd.DataFrame(np.frombuffer(blob, "<i8").reshape(-1, 5), columns=["doc", "first", "shift", "low", "high"]).astype(_FOUND)
    return found.assign(first=found["first"].mask(found["first"] == NO_FIRST))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether rows of a and b reach the similarity as sets."""
    a, b, both = np.sort(a, axis=1), np.sort(b, axis=1), np.sort(np.concatenate([a, b], axis=1), axis=1)
    size = [1 + (x[:, 1:] != x[:, :-1]).sum(axis=1) for x in (a, b, both)]
    return den * (size[0] + size[1] - size[2]) >= num * size[2]


def united(pair: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Union of the ranges low <= i < high of each pair and shift."""
    order = np.lexsort((low, shift, pair))
    pair, shift, low, high = pair[order], shift[order], low[order], high[order]
    if not len(order):
        return pair, shift, low, high
    group = np.cumsum(np.concatenate([[0], (np.diff(pair) != 0) | (np.diff(shift) != 0)]))
    far = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + far)
    at = np.flatnonzero(np.concatenate([[True], (low + far)[1:] > reach[:-1]]))
    return pair[at], shift[at], low[at], np.append(reach[at[1:] - 1], reach[-1]) - far[at]


def verified(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray, starts: np.ndarray,
             tokens: int, width: int, num: int, den: int):
    """Passages among ranges of proposed starts: a[left + i:][:tokens] lies against
    b[right + i:][:tokens] for 0 <= i < starts of each range.

    Returns range, first start and words of the merged passages, from the first to the last
    token that is the same in both; a passage that is similar as a set only is whole.
    """
    size = starts + tokens - 1
    equal = a[_ranges(left, left + size)] == b[_ranges(right, right + size)]
    same = np.concatenate([[0], np.cumsum(equal)])
    first = np.cumsum(size) - size
    start = _ranges(first, first + starts)
    count = same[start + tokens] - same[start]
    row = np.repeat(np.arange(len(starts)), starts)
    i = start - first[row]
    sure = count == tokens
    look = np.flatnonzero(~sure)
    inside = np.arange(tokens)
    for some in np.array_split(look, max(1, len(look) // 20_000)):
        x, y = (left[row[some]] + i[some])[:, None], (right[row[some]] + i[some])[:, None]
        sure[some] = _alike(a[x + inside], b[y + inside], num, den)
    row, i, aligned = row[sure], i[sure], count[sure] >= tokens // 4
    if not len(row):
        return row, i, i
    at = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(i) > width)]))
    stop = np.append(at[1:], len(i)) - 1
    place = np.arange(len(equal))
    after = np.minimum.accumulate(np.where(equal, place, len(equal))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(equal, place, -1))
    base, row = first[row[at]], row[at]
    x = np.where(aligned[at], after[base + i[at]] - base, i[at])
    y = np.where(aligned[stop], before[base + i[stop] + tokens - 1] - base, i[stop] + tokens - 1)
    return row, x, y - x + width - tokens + 1


def _lists(column, fields) -> tuple[np.ndarray, dict]:
    """Row of each element of a list column, and its fields."""
    parts = column.flatten()
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return rows, {f: parts.field(f) for f in fields}


def passages(docs: DataFrame, k: int = 5, min_words: int = 50, num: int = 80, den: int = 100) -> DataFrame:
    """One row per passage and smaller document that holds it: _id, first_id, start_word,
    n_words, first_word (where it starts there)."""
    tokens = min_words - k + 1

    def slices(portion: dict) -> Iterator[pd.DataFrame]:
        """The smaller document's tokens of each range, 32 bits of each."""
        b, n, _ = shingles(portion["_other"], k)
        pair, found = _lists(portion["ranges"], ("shift", "low", "high"))
        pair, shift, low, high = united(pair, *[f.to_numpy(zero_copy_only=False).astype(np.int64) for f in found.values()])
        low, high = np.maximum(low, np.maximum(0, -shift)), np.minimum(high, n[pair] - shift - tokens + 1)
        good = high > low
        pair, shift, low, high = pair[good], shift[good], low[good], high[good]
        b, right = (b >> np.uint64(32)).astype("<u4"), (np.cumsum(n) - n)[pair] + low + shift
        yield pd.DataFrame({
            "doc": portion["doc"].to_numpy()[pair], "first": portion["first"].to_numpy()[pair], "shift": shift,
            "low": low, "high": high, "tokens": [
                b[x:y].tobytes() for x, y in zip(right, right + high - low + tokens - 1)]})

    def verify(portion: dict) -> Iterator[pd.DataFrame]:
        a, n, _ = shingles(portion["_text"], k)
        doc, found = _lists(portion["ranges"], ("first", "shift", "low", "high", "tokens"))
        first, shift, low, high = (found[f].to_numpy(zero_copy_only=False).astype(np.int64)
                                   for f in ("first", "shift", "low", "high"))
        b = np.frombuffer(b"".join(found["tokens"].to_pylist()), "<u4")
        size = high - low + tokens - 1
        right = np.cumsum(size) - size
        starts = np.minimum(high, n[doc] - tokens + 1) - low
        good = np.flatnonzero(starts > 0)
        row, i, words = verified((a >> np.uint64(32)).astype("<u4"), ((np.cumsum(n) - n)[doc] + low)[good], b, right[good],
                                 starts[good], tokens, min_words, num, den)
        row = good[row]
        yield pd.DataFrame({"_id": portion["doc"].to_numpy()[doc[row]], "first_id": first[row], "start_word": low[row] + i,
                            "n_words": words, "first_word": low[row] + shift[row] + i})

    found = materialize(candidates(docs, k, tokens, num, den))
    release(docs.sparkSession)
    texts = row_keys(docs).select("_id", whole_text().alias("_text"))
    pairs = found.join(texts.select(F.col("_id").alias("first"), F.col("_text").alias("_other")), "first")
    cut = map_texts(pairs.select("doc", "first", "ranges", "_other"), slices, "doc long, first long, shift int, "
                    "low int, high int, tokens binary", MAP_CHARS, ("_other",))
    # One plan with the join before it, so the shuffled texts are there once for both.
    cut = cut.groupBy("doc").agg(F.collect_list(F.struct("first", "shift", "low", "high", "tokens")).alias("ranges"))
    both = cut.join(texts.select(F.col("_id").alias("doc"), "_text"), "doc")
    return map_texts(both.select("doc", "ranges", "_text"), verify, "_id long, first_id long, start_word int, "
                     "n_words int, first_word int", MAP_CHARS).distinct()


def drop_passages(docs: DataFrame, **rule) -> DataFrame:
    """The input's rows and columns without passages that a smaller document holds.

    Each word goes with the white space behind it; n_chars follows the text; a document of
    which no word is left goes. Rows without such a passage are returned as they are.
    """
    found = materialize(passages(docs, **rule))
    release(docs.sparkSession)
    spans = found.groupBy("_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, found in zip(pdf["text"], pdf[SPANS]):
                if found is None or text is None:
                    texts.append(text)
                    continue
                _, begin, _, _ = word_spans([text])
                raw = text.encode()
                edge = np.append(begin, len(raw))
                keep = np.ones(len(raw), bool)
                for s in found:
                    keep[edge[min(s["start_word"], len(begin))]:edge[min(s["start_word"] + s["n_words"], len(begin))]] = False
                texts.append(np.frombuffer(raw, np.uint8)[keep].tobytes().decode())
            pdf["text"] = texts
            yield pdf.drop(columns=SPANS)

    joined = whole_rows(docs).drop("_h").join(spans, "_id", "left")
    touched = joined.where("_spans is not null").select("_row.*", F.col("_spans").alias(SPANS)).mapInPandas(
        cut, T.StructType([f for f in docs.schema.fields])).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where("_spans is null").select("_row.*").unionByName(touched)

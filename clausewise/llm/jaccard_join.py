"""Size-aware n-gram Jaccard join and its connected components.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``num``/``den``. Documents with the same set are one class from the start.

- Light sets (up to the boundary) enumerate, for every size a partner may have, all subsets
  of the size that the overlap must reach; linked sets share one.
- Heavy sets have inverted lists that are scanned. A list is keyed by a block of the hash
  space together with all of the set's shingles in it. With more blocks than shingles in
  which two linked sets of that size class can differ, they agree in a block; lists of
  single shingles would hold all documents with a common phrase. ``spare`` further blocks
  make up for blocks that are empty in both; a set with more empty ones than that is also
  listed under its prefix (its smallest hashes), where linked sets always meet.
- The boundary is the largest size up to which subsets are no more keys than blocks.

The classes of a list are compared with its first one, then, in rounds, those outside the
list's largest component with a leader out of it, another one each time: as many pairs as
the list has classes. Lists that are connected are done. Only what is left over then, and
only where parity bitmaps allow the overlap, is compared with all of its list. All
comparisons are on the whole sets, so the components are exact.

Null and empty text have no shingle and link with nothing, not with each other. Null ids
count as one lowest id; repeated rows fall into one class. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import map_texts, materialize, release, row_keys, whole_rows, whole_text
from clausewise.llm.shingles import mix, shingles
from clausewise.operators.ordering import lookup_skew_safe, top_k

KEYS_PER_BUCKET = 500_000
ROWS_PER_FILE, PAIRS_PER_TASK = 500_000, 20_000
MAP_CHARS = 1_000_000
BITMAP = [f"b{i}" for i in range(16)]
#: Rounds in which classes meet one leader a list, and leaders that a class meets of each component.
LEADER_ROUNDS, NEAREST = 3, 3


@dataclass(frozen=True)
class Rule:
    """Shingle size and least similarity num/den."""

    k: int = 4
    num: int = 85
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    @cached_property
    def classes(self) -> list[int]:
        """First sizes of the size classes; linked sets are in the same or the next one."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(self.den * out[-1] // self.num + 1)
        return out

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.classes, n, side="right")) - 1

    def blocks(self, c: int) -> tuple[int, int]:
        """Blocks, and spare ones among them, for pairs whose smaller set is in class c."""
        differ = (self.classes[c + 1] - 1) * (self.den - self.num) // self.num
        spare = 1 + differ // 16
        return differ + 1 + spare, spare

    @cached_property
    def boundary(self) -> int:
        n = 1
        while True:
            light = sum(math.comb(n + 1, n + 1 - self.overlap(n + 1, m)) for m in self.partners(n + 1))
            c = self.size_class(n + 1)
            if light > self.blocks(c)[0] + (self.blocks(c - 1)[0] if c else 0):
                return n
            n += 1

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set of distinct sorted hashes; linked sets that differ share one."""
        n, out = len(h), []
        if n < 2:
            return np.zeros(0, np.uint64)
        x = self.boundary
        if n <= x:
            own = mix(h, 11)
            total = own.sum(dtype=np.uint64)
            for m in self.partners(n):
                if m <= x:
                    gone = n - self.overlap(n, m)
                    left = [sum((own[i] for i in d), np.uint64(0)) for d in combinations(range(n), gone)]
                    tag = np.uint64((min(n, m) << 32) | max(n, m))
                    out.append(mix(total - np.array(left, np.uint64) + tag, 12))
        if self.partners(n)[-1] > x:
            c = self.size_class(n)
            place, own = mix(h, 13) >> np.uint64(32), mix(h, 14)
            for pair_class in (c, c - 1) if c else (c,):
                blocks, spare = self.blocks(pair_class)
                at = (place * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                filled = np.unique(at)
                sums = np.zeros(blocks, np.uint64)
                np.add.at(sums, at, own)
                tag = filled.astype(np.uint64) + np.uint64(pair_class << 40)
                out.append(mix(mix(sums[filled], 15) + tag, 16))
                if blocks - len(filled) > spare:
                    out.append(mix(h[:n - -(-self.num * n // self.den) + 1] + np.uint64(pair_class << 40), 17))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    h, n, _ = shingles(texts, k)
    at = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(texts)):
        yield np.unique(h[at[i]:at[i + 1]])


def _prints(h: np.ndarray) -> tuple[int, int]:
    a, b = (mix(h, s).sum(dtype=np.uint64) for s in (21, 22))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _measured(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row: _id, _h, n and the set's fingerprints and parity bitmap."""
    def run(portion: dict) -> Iterator[pd.DataFrame]:
        rows = []
        for h in _sets(portion["_text"], rule.k):
            bits = np.packbits(np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=1024) & 1)
            rows.append((len(h), *_prints(h), *bits.view("<i8").tolist()))
        out = pd.DataFrame(rows, columns=["n", "f", "g", *BITMAP])
        out.insert(0, "_h", portion["_h"].to_numpy())
        out.insert(0, "_id", portion["_id"].to_numpy())
        yield out

    return map_texts(row_keys(docs).select("_id", "_h", whole_text().alias("_text")), run,
                     "_id long, _h long, n long, f long, g long, " + ", ".join(f"{b} long" for b in BITMAP), MAP_CHARS)


def _lists(docs: DataFrame, rule: Rule, total_chars: int) -> DataFrame:
    """(key, f) of all keys that two classes or more have.

    Keys go to buckets as packed arrays. What repeats within a batch is known at once and
    sends only one of its classes on, so a key that a third of the rows have is one entry
    for each batch.
    """
    buckets = max(8, total_chars // 6 * 2 // 5 // KEYS_PER_BUCKET)

    def send(portion: dict) -> Iterator[pd.DataFrame]:
        keys, prints = [], []
        for h in _sets(portion["_text"], rule.k):
            keys.append(rule.keys(h))
            prints.append(np.full(len(keys[-1]), _prints(h)[0] if len(keys[-1]) else 0, np.int64))
        key, f = np.concatenate(keys), np.concatenate(prints)
        if not len(key):
            return
        key, f = _distinct(key, f)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        more = np.concatenate([~first[1:], [False]])
        many = ~first | more
        bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        rows = [(int(bucket[many][0]), 1, key[many].tobytes(), f[many].tobytes())] if many.any() else []
        key, f, bucket = key[first], f[first], bucket[first]  # still sorted by key
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows += [(i, 0, key[x:y].tobytes(), f[x:y].tobytes())
                 for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        yield pd.DataFrame(rows, columns=["bucket", "kind", "keys", "prints"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in (0, 1):
            part = pdf[pdf["kind"] == kind]
            if not len(part):
                continue
            key = np.frombuffer(b"".join(part["keys"]), np.uint64)
            f = np.frombuffer(b"".join(part["prints"]), np.int64)
            key, f = _distinct(key, f)
            if not kind:
                first = np.concatenate([[True], key[1:] != key[:-1]])
                many = ~first | np.concatenate([~first[1:], [False]])
                key, f = key[many], f[many]
            out.append(pd.DataFrame({"key": key.view(np.int64), "f": f}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "f": []})

    rows = map_texts(docs.select(whole_text().alias("_text")), send,
                     "bucket int, kind int, keys binary, prints binary", MAP_CHARS)
    return rows.groupBy("bucket").applyInPandas(meet, "key long, f long").distinct()


def _distinct(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((f, key))
    key, f = key[order], f[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (f[1:] != f[:-1])
    return key[new], f[new]


def _settled(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Computed once, in files of some size: at most ``rows`` rows are expected."""
    return materialize(df.coalesce(max(8, rows // per_file)))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of edges (u, v); comp is the component's smallest node.

    Alternating large and small stars, each round checkpointed, until nothing changes.
    """
    def oriented(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    rows, state = edges.count(), None
    e = _settled(oriented(edges), rows)
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))\
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _settled(large.where("u <> v").distinct(), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = _settled(oriented(small), 2 * rows)


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (u, v) of classes those that link, by their whole sets."""
    joined = (pairs.join(sets.select(F.col("f").alias("u"), F.col("set").alias("s")), "u")
              .join(sets.select(F.col("f").alias("v"), F.col("set").alias("t")), "v"))
    both = F.size(F.array_intersect("s", "t"))
    return joined.where(rule.den * both >= rule.num * (F.size("s") + F.size("t") - both)).select("u", "v")


def _links(docs: DataFrame, measured: DataFrame, rule: Rule) -> DataFrame:
    """(node, comp) of all classes that link with another one."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    lists = materialize(_lists(docs, rule, total))
    most = lists.count()
    release(docs.sparkSession)
    classes = (measured.where("n > 0").groupBy("f").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), *[
        F.first(b).alias(b) for b in BITMAP]).join(lists.select("f").distinct(), "f", "left_semi"))
    classes = materialize(classes)

    def encode(portion: dict) -> Iterator[pd.DataFrame]:
        found = [(_prints(h)[0], h.view(np.int64)) for h in _sets(portion["_text"], rule.k)]
        yield pd.DataFrame(found, columns=["f", "set"])

    texts = row_keys(docs).select("_id", whole_text().alias("_text")).join(classes.select("_id"), "_id", "left_semi")
    sets = map_texts(texts, encode, "f long, set array<long>", MAP_CHARS)
    if not measured.groupBy("_id").count().where("count > 1").isEmpty():  # rows that repeat an id
        sets = sets.dropDuplicates(["f"])
    sets = materialize(sets)
    release(docs.sparkSession)
    # Each class with the first class of the list set it shares most lists with.
    first = lists.groupBy("key").agg(F.min("f").alias("v"))
    shared = lists.join(first, "key").where("f <> v").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    star = shared.groupBy("f").agg(F.max_by("v", F.struct("n", "v")).alias("v")).select(F.col("f").alias("u"), "v")
    tested = _settled(star, most // 4)
    edges = _settled(_verified(tested, sets, rule), most // 4, PAIRS_PER_TASK)
    for step in (*range(LEADER_ROUNDS), "all", "done"):
        comps = _settled(components(edges), most // 4)
        release(docs.sparkSession)
        if step == "done":
            break  # all that may link have been compared
        node = comps.withColumnRenamed("node", "f")
        placed = lists.join(node, "f", "left").select("key", "f", F.coalesce("comp", "f").alias("comp"))
        open_ = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
        # Lists whose classes are all connected are done for good.
        placed = _settled(placed.join(open_.select("key"), "key", "left_semi"), most)
        lists = placed.select("key", "f")
        largest = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
            F.max_by("comp", F.struct("n", "comp")).alias("largest"))
        split = placed.join(largest, "key").join(classes.select("f", "n", *BITMAP), "f")
        names = lambda d, p: d.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("f", "n", "comp", *BITMAP)])
        if step == "all":
            a, b = names(split.where("comp <> largest"), "u"), names(split, "v")
        else:
            # One class of the list's largest component, another one each time.
            lead = F.min_by(F.struct("f", "n", "comp", *BITMAP), F.xxhash64("f", F.lit(step)))
            a = names(split.where("comp <> largest"), "u")
            b = names(split.where("comp = largest").groupBy("key").agg(lead.alias("l")).select("key", "l.*"), "v")
        apart = sum((F.bit_count(F.col(f"u{x}").bitwiseXOR(F.col(f"v{x}"))) for x in BITMAP), F.lit(0))
        differ = F.floor((rule.den - rule.num) * (F.col("un") + F.col("vn")) / (rule.den + rule.num))
        near = a.join(b, [a["key"] == b["key"], F.col("ucomp") != F.col("vcomp"), apart <= differ])
        near = near.select(F.greatest("uf", "vf").alias("u"), F.least("uf", "vf").alias("v"), F.col("uf").alias("w"),
                           F.col("vcomp").alias("y"), apart.alias("d"))
        if step != "all":  # of each class and each other component the nearest leaders
            near = top_k(near.distinct(), ["w", "y"], [F.col("d"), F.col("u"), F.col("v")], NEAREST)
        done = tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        fresh = near.select("u", "v").distinct().join(done, ["u", "v"], "left_anti")
        fresh = _settled(fresh, most)
        release(docs.sparkSession)
        if fresh.isEmpty():
            if step == "all":
                break
            continue
        tested = tested.unionByName(fresh)
        edges = _settled(edges.unionByName(_verified(fresh, sets, rule)), most // 4, PAIRS_PER_TASK)
    return comps


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per input row: _id, _h, n_shingles, component_id (smallest doc_id reachable)."""
    measured = materialize(_measured(docs, rule))
    comps = _links(docs, measured, rule)
    some = measured.where("n > 0")
    # Copies need no shuffle row each: the class table is small against the rows.
    table = some.groupBy("f").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    table = table.join(comps.withColumnRenamed("node", "f"), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    smallest = table.groupBy("comp").agg(F.min("least").alias("component"))
    table = lookup_skew_safe(table.withColumn("_one", F.lit(1)), materialize(
        table.groupBy("comp").agg(F.count(F.lit(1)).alias("classes")).join(smallest, "comp")),
        "comp", "classes", "f", ["component"])
    table = materialize(table.select("f", "rows", "component"))
    out = lookup_skew_safe(measured, table, "f", "rows", "_id", ["component"])
    return out.select("_id", "_h", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(
        F.col("component")).alias("component_id"))


def drop_near_copies(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """The input's rows and columns; of each component the smallest doc_id stays."""
    gone = jaccard_components(docs, rule).where("_id <> component_id").select("_id", "_h").distinct()
    return whole_rows(docs).join(gone, ["_id", "_h"], "left_anti").select("_row.*")

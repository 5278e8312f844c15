"""How far the sources of a language diverge in their words, by a three-dimensional cube.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as one).
Tasks count terms per (lang, source) before anything is shuffled. A language keeps the terms
of at least ``min_docs`` of its documents; each of its sources then has a smoothed share of
every kept term, in billionths, in whole numbers.

Pairs of sources are compared in cells of a cube: (block of sources, block of sources, block
of terms). Counts are replicated to the cells of their two blocks, a cell fills two small
dense slices and gives the partial divergence of each pair from them, and the partial sums
are added along the axis of terms. A cell holds ``block_groups`` sources twice and
``block_terms`` terms in the mean, whatever the number of documents; terms that neither
source of a pair has come in by their number alone. Both blocks are dealt by hash, so a
source with a third of all rows is a row of its block like any other.

Null text, lang and source are ''. An empty text has no terms, and its group still takes
part; a language without kept terms has divergences of 0. Repeated rows each count as a
document; equal values are ranked by the item's bytes; an empty table gives an empty
result. Other columns of the input are ignored. Shares are exact while a language has fewer
than 9 * 10^15 occurrences.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialize

#: Letters of terms stay, A-Z as a-z; all other bytes are blanks. Bytes from 0x80 on belong
#: to characters beyond ASCII.
_LETTERS = bytes(b if chr(b).isalpha() else 0x20 for b in range(0x80)).lower() + bytes(range(0x80, 0x100))
_PIECE = 1 << 20
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Smoothing and scale of shares.
SMOOTH, SCALE_STEPS = 5, 3


def _pieces(data: bytes):
    """A text's letters and blanks, cut at blanks into pieces of about a megabyte."""
    data, start = data.translate(_LETTERS), 0
    while len(data) - start > _PIECE:
        cut = data.rfind(b" ", start, start + _PIECE)
        if cut <= start:
            cut = data.find(b" ", start + _PIECE)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


def _count(batches):
    """Term counts of one task per group, given out whenever a quarter of a million are held."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])
    occurrences: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def flush():
        for (lang, source), counts in occurrences.items():
            seen, terms = documents[lang, source], list(counts)
            # A group is told even without terms.
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([None, *terms], pa.string()), pa.array([0, *counts.values()], pa.int64()),
                pa.array([0, *map(seen.__getitem__, terms)], pa.int64())], schema=schema)
        occurrences.clear()
        documents.clear()

    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i, group in enumerate(zip(langs, sources)):
            counts = occurrences.setdefault(group, Counter())
            documents.setdefault(group, Counter())
            before, seen = len(counts), set()
            for piece in _pieces(batch.column("text")[i].as_py()):
                words = piece.split()
                counts.update(words)
                seen.update(words)
            documents[group].update(seen)
            held += len(counts) - before
            if held > 250_000:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; one row with a null term per group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text("lang").alias("lang"), text("source").alias("source"),
                    text("text").cast("binary").alias("text"))
    return (d.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total), by long division in steps of a thousand."""
    out, rest = F.lit(1).cast("long"), count
    for i in range(SCALE_STEPS):
        out = out + F.call_function("div", rest * 1000, total) * 1000 ** (SCALE_STEPS - 1 - i)
        rest = F.pmod(rest * 1000, total)
    return out


def _attach(rows: DataFrame, table: DataFrame, on: list[str], by: str, limit: int = 50_000, salts: int = 16) -> DataFrame:
    """Inner join of a materialized table with one row per key; beyond ``limit`` counted rows
    every key is repeated under ``salts`` salts, dealt to the rows by a hash of ``by``."""
    if table.count() <= limit:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


class Shares:
    """Materialized tables: ``groups`` (lang, source, base, v, blocks, ...), ``entries``
    (lang, source, term, p, q). ``base`` is a group's share of a term it does not have."""

    def __init__(self, docs: DataFrame, min_docs: int, block_groups: int, block_terms: int):
        counts = materialize(term_counts(docs))
        terms = counts.where("term is not null")
        kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs"))
        kept = kept.where(F.col("all_docs") >= min_docs).drop("all_docs")
        entries = materialize(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
        named = counts.where("term is null").select("lang", "source")
        sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = named.join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
        vocabulary = entries.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
            F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_total"))
        langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(vocabulary, "lang", "left")
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
        langs = materialize(langs.select(
            "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
            blocks("sources", block_groups).alias("group_blocks"),
            F.coalesce(blocks("v", block_terms), F.lit(1)).alias("term_blocks")))
        over = lambda total: F.col(total) + SMOOTH * F.col("v")
        groups = _attach(groups, langs, ["lang"], "source").withColumn("denominator", over("total"))
        self.groups = materialize(groups.withColumn("base", F.when(
            F.col("v") > 0, share(F.lit(SMOOTH).cast("long"), F.col("denominator"))).otherwise(F.lit(0))))
        weighed = _attach(entries, self.groups, ["lang", "source"], "term")
        self.entries = weighed.select(
            "lang", "source", "term", "base", "v", "group_blocks", "term_blocks",
            share(F.col("n") + SMOOTH, F.col("denominator")).alias("p"),
            share(F.col("all_n") + SMOOTH, over("lang_total")).alias("q"))


def _cell(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergence of every pair of a cell's sources, over the cell's terms and, in
    the first block of terms, what the sources' base shares differ by over all terms."""
    _, a, b, block = key
    heads = rows[rows["term"].isna()]
    heads = heads.sort_values("source", kind="stable", ignore_index=True)
    here = rows[rows["term"].notna()]
    names, base = pd.Index(heads["source"]), heads["base"].to_numpy(np.int64)
    term, distinct = pd.factorize(here["term"])
    p = np.repeat(base[:, None], len(distinct), axis=1)
    p[names.get_indexer(here["source"]), term] = here["p"].to_numpy(np.int64)
    side = heads["side"].to_numpy()
    v = int(heads["v"].iloc[0]) if block == 0 else 0
    out = []
    for i in np.flatnonzero(side == a):
        j = np.flatnonzero(side == b)
        j = j[j > i] if a == b else j
        if len(j):
            apart = np.abs(base[j] - base[i])
            value = np.abs(p[j] - p[i]).sum(axis=1) + apart * (v - len(distinct))
            out.append(pd.DataFrame({"lang": key[0], "one": names[i], "two": names[j], "value": value}))
    return pd.concat(out) if out else pd.DataFrame(columns=["lang", "one", "two", "value"])


def pair_divergence(shares: Shares) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    other = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1))
    side = lambda d: d.withColumns({"side": F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int")})
    heads = side(shares.groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).select(
        "*", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    entries = side(shares.entries).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    columns = ["lang", "side", "block", "source", "term", "p", "base", "v"]
    slices = heads.select(*columns, other.alias("other")).unionByName(entries.select(*columns, other.alias("other")))
    cells = slices.withColumns({"a": F.least("side", "other"), "b": F.greatest("side", "other")}).drop("other")
    partial = cells.groupBy("lang", "a", "b", "block").applyInPandas(
        _cell, "lang string, one string, two string, value long")
    total = partial.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                   F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    return total.select("lang", "value", F.explode(both).alias("pair")).select("lang", "pair.source", "pair.item", "value")


def term_excess(shares: Shares) -> DataFrame:
    """lang, source, item (a term the source has more often than its language), value."""
    e = shares.entries.where("p > q")
    return e.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, block_groups: int = 200,
               block_terms: int = 1024) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: summed absolute difference of all shares to each other source of the
    language. Part ``term``: the ``top_terms`` terms whose share exceeds the language's most.
    """
    shares = Shares(docs, min_docs, block_groups, block_terms)
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(w).alias("rank")
    pairs = pair_divergence(shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = term_excess(shares).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))

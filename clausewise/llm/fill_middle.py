"""Fill-in-the-middle transformation over a Fenwick tree of text blocks.

A text is cut at two drawn units into prefix, middle and suffix, and is written with the
suffix in front of the middle, so that a model learns to fill a gap. A unit is one code
point, or a match of ``unit`` together with all up to the next match.

Per text a Fenwick tree over fixed blocks of bytes stores how many units and code points
begin in each block. Descending it by binary lifting finds the block of a drawn unit and the
code points before it in as many steps as the number of blocks has bits; the cut itself is
found inside that block. A text of any length is looked at once, and its cuts fall at the
same bytes whatever the block size.

Draws are the first four 8-digit groups of sha256("<seed>:<doc_id>"), so a retried task
cuts the same way. Null and empty texts are plain, as are texts that hold one of the three
marks; a null doc_id is drawn as an empty one; repeated rows get equal results; an empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import map_texts, whole_text

#: Marks in front of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
BLOCK = 4096
#: A word with the white space behind it, for units larger than code points.
WORD = rb"[^\x20\x09-\x0D]+"


class FenwickBlocks:
    """Unit and code point counts of a text's blocks of ``block`` bytes."""

    def __init__(self, data: bytes, unit: re.Pattern | None = None, block: int = BLOCK):
        self.block, self.size = block, len(data)
        self.points = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        self.units = self.points
        if unit is not None:
            begin = np.fromiter((m.start() for m in unit.finditer(data)), np.int64)
            self.units = np.zeros(len(data), bool)
            self.units[begin] = True
            if len(begin):  # what stands before the first match belongs to it
                self.units[begin[0]], self.units[0] = False, True
        edges = np.arange(0, len(data), block)
        counts = np.zeros((len(edges) + 1, 2), np.int64)
        if len(edges):
            counts[1:, 0] = np.add.reduceat(self.units, edges, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(self.points, edges, dtype=np.int64)
        upto = np.cumsum(counts, axis=0)
        node = np.arange(len(upto))
        self.tree = upto - upto[node - (node & -node)]
        self.n_units, self.n_points = map(int, upto[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """Byte offset and code points before unit ``k``; the text's end for the last one's end."""
        if k >= self.n_units:
            return self.size, self.n_points
        at, points, step = 0, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step, 0] <= k:
                at += step
                k -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        begin = at * self.block
        inside = int(np.flatnonzero(self.units[begin:begin + self.block])[k])
        return begin + inside, points + int(np.count_nonzero(self.points[begin:begin + inside]))


def arrange(data: bytes, draws: list[int], unit: re.Pattern | None, plain: int, spm: int) -> tuple:
    """units, form, code points of prefix and middle, output of one text."""
    blocks = FenwickBlocks(data, unit)
    n, marks = blocks.n_units, [m.encode() for m in MARKS]
    if not data or any(m in data for m in marks) or draws[2] % 100 >= 100 - plain:
        return n, "plain", None, None, data
    low, high = sorted(d % (n + 1) for d in draws[:2])
    (i, before), (j, through) = blocks.cut(low), blocks.cut(high)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    p, s, m = marks
    if draws[3] % 100 < spm:
        return n, "spm", before, through - before, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", before, through - before, b"".join([p, prefix, s, suffix, m, middle])


def draws(seed: str) -> Column:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20,
                   unit: bytes | None = None, chars: int = 4_000_000) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    ``unit`` is a pattern over UTF-8 bytes whose matches begin units; none: code points.
    """
    pattern = re.compile(unit) if unit else None

    def run(columns):
        ids, drawn = columns["doc_id"], columns["_draws"].to_pylist()
        rows = [arrange(t, d, pattern, plain_percent, spm_percent) for t, d in zip(columns["_text"], drawn)]
        n, form, before, middle, output = zip(*rows)
        yield pd.DataFrame({"doc_id": ids.to_pandas(types_mapper=pd.ArrowDtype), "n": n, "form": form,
                            "prefix_chars": pd.array(before, "Int64"), "middle_chars": pd.array(middle, "Int64"),
                            "output": pd.Series(output, dtype=object)})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("_text"),
                    draws(seed).alias("_draws"))
    return map_texts(d, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", chars)


def restored(output: Column, form: Column) -> Column:
    """The whole text from what fill_in_middle() gave out. A text in one of the marked forms
    held no mark, so each mark is found where it was put."""
    p, s, m = map(F.lit, MARKS)
    one, two = F.lit(1), F.lit(2)
    head, middle = F.split_part(output, m, one), F.split_part(output, m, two)
    psm = F.concat(F.split_part(F.split_part(head, s, one), p, two), middle, F.split_part(head, s, two))
    spm = F.concat(F.split_part(head, p, two), middle, F.split_part(F.split_part(head, p, one), s, two))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

"""Encoding and decoding with a SentencePiece model through distinct-chunk tables.

Where no piece of the model has a white-space marker after another character, segments
cannot cross the start of a run of markers. A text is then cut into marked words (a run of
markers and what follows up to the next), each distinct marked word is segmented and
decoded once by the library, and ids and text are joined back by position. The table of
distinct words belongs to one Python worker and is bounded; no result depends on it. (One
table of the whole corpus, joined by shuffle, would move every word of every text.) A model
whose pieces do cross markers is applied to whole texts.

Null and empty text give the begin and end ids alone and decode to an empty text; repeated
rows, null ids and other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clausewise.llm.common import WordTable

MARK = "▁"
_RUNS = re.compile(r" +[^ ]*")


class ChunkCoder:
    """Codes texts by a table of marked words: (ids as 32-bit integers, decoded text)."""

    def __init__(self, model_file: str, table_size: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # A white space of its own, the dummy prefix, and nothing else changed by the model.
        probe = f"  a  b {MARK}c\t\n "
        self.cut = self.cut and self.sp.decode(self.sp.encode(probe)) == probe.replace(MARK, " ")
        self.begin, self.end = self.ids_of([self.sp.bos_id()]), self.ids_of([self.sp.eos_id()])
        self.table = WordTable(self._segment, table_size)
        #: Words that do not decode to themselves; with byte fallback there is none.
        self.changed: dict[str, str] = {}

    @staticmethod
    def ids_of(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _segment(self, chunks: list[str]) -> list[bytes]:
        ids = self.sp.encode(chunks, num_threads=1)
        if "" in chunks:  # the dummy prefix alone
            ids[chunks.index("")] = [self.sp.piece_to_id(MARK)]
        for c, text in zip(chunks, self.sp.decode(ids, num_threads=1)):
            if c != text:
                self.changed[c] = text
        return [self.ids_of(i) for i in ids]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Marked words without their first marker, which the library's dummy prefix adds."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _RUNS.findall(" " + text)]
        return text.split(" ")

    def code(self, text: str) -> tuple[bytes, str]:
        if not self.cut:
            ids = self.sp.encode(text)
            return self.begin + self.ids_of(ids) + self.end, self.sp.decode(ids)
        chunks = self.chunks(text)
        ids = b"".join([self.begin, *self.table.of(chunks), self.end])
        if self.changed and not self.changed.keys().isdisjoint(chunks):
            chunks = [self.changed.get(c, c) for c in chunks]
        return ids, " ".join(chunks)


@functools.cache
def _coder(model_file: str, table_size: int) -> ChunkCoder:
    """One for all tasks of a Python worker."""
    return ChunkCoder(model_file, table_size)


def encode_decode(docs: DataFrame, model_file: str | None = None, text: str = "text",
                  table_size: int = 300_000, rows_out: int = 500) -> DataFrame:
    """The input's columns with ``piece_ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded``; columns of those names are replaced."""
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    keep = docs.drop("piece_ids", "decoded")
    schema = T.StructType([*keep.schema.fields, T.StructField("piece_ids", T.BinaryType()),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model_file, table_size)
        for whole in batches:
            for at in range(0, len(whole), rows_out):
                pdf = whole.iloc[at:at + rows_out].copy()
                coded = [coder.code(t or "") for t in pdf[text]]
                pdf["piece_ids"], pdf["decoded"] = [c[0] for c in coded], [c[1] for c in coded]
                yield pdf

    return keep.mapInPandas(run, schema)

"""Packing of documents into windows by lexical retrieval.

Documents are tokenized (each distinct white-space word once per task) and dealt by a hash
of their id to partitions. A partition is read in shards of bounded size; each shard has a
BM25 inverted index over its documents' token ids. The first unused document seeds a
window, its unused neighbours by score fill it, the last one is cut, and its rest seeds the
next window. What is open at the end of a shard goes on in the next; at the end of a
partition it is cut into sequences whose lengths are powers of two, so nothing is padded.

Null and empty text are a document of the end id alone; a null id is carried as it is;
repeated rows are packed each for itself; an empty table gives an empty result. Other
columns are ignored. Sequences do not depend on the order of rows, as partitions are sorted
before they are packed.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import WordTable, whole_text

WINDOW = 4096
K1, B = 1.2, 0.75
PIECES = ("sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary")


def _byte_chars() -> dict[int, str]:
    """Byte -> its printable stand-in in a byte-level vocabulary: printable Latin-1 stands
    for itself, all others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class WordIds:
    """Ids of texts as 16-bit integers, by a table of white-space words."""

    def __init__(self, file: str, size: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        if self.tok.get_vocab_size() > 65536:
            raise ValueError("ids must fit in 16 bits")
        self.words, self.ends = WordTable(self._encode, size), {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}H", *e.ids)
                for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Lower-case Latin letters are one pre-token that no normalization changes, so the
        model takes their bytes directly, and full stops and commas behind them are a
        pre-token of their own; all else goes through the whole tokenizer."""
        model, ends, out, other = self.tok.model.tokenize, self.ends, [], []
        for w in words:
            core = w.rstrip(".,")
            if core.isascii() and core.islower() and core.isalpha():
                found = [t.id for t in model(core)]
            elif core.isalpha() and max(core) < "\u0250" and core == core.lower():
                found = [t.id for t in model(core.encode().decode("latin-1").translate(BYTE_CHARS))]
            else:
                other.append(len(out))
                out.append(w)
                continue
            end = w[len(core):]
            if end not in ends:
                ends[end] = self._whole([end])[0]
            out.append(struct.pack(f"<{len(found)}H", *found) + ends[end])
        for i, ids in zip(other, self._whole([out[i] for i in other])):
            out[i] = ids
        return out

    def ids(self, text: str) -> bytes:
        """Words end at blanks and line ends, which no token of the vocabulary spans."""
        if "<" not in text and _latin1(text):
            text = text.lower()  # as the tokenizer does; a special token keeps its case
        return b"".join(self.words.of(text.replace("\n", " ").split(" ")))


def _latin1(text: str) -> bool:
    """Whether lower() acts on each character alone."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.cache
def _words(file: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(file)


def tokenize(docs: DataFrame, file: str, end_id: int, rows_out: int = 2000) -> DataFrame:
    """doc_id and the document's ids, the end id included, as binary 16-bit integers."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(file)
        for whole in batches:
            for at in range(0, len(whole), rows_out):
                pdf = whole.iloc[at:at + rows_out]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids16": [words.ids(t) + end for t in pdf["_text"]]})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("_text")).mapInPandas(
        run, "doc_id long, ids16 binary")


class Shard:
    """BM25 inverted index of some documents' token ids."""

    def __init__(self, docs: list[np.ndarray], terms: int):
        self.n, self.terms = len(docs), terms
        found = [np.unique(d, return_counts=True) for d in docs]
        size = np.array([len(f[0]) for f in found])
        term = np.concatenate([f[0] for f in found]).astype(np.int64)
        tf = np.concatenate([f[1] for f in found])
        doc = np.repeat(np.arange(self.n), size)
        df = np.bincount(term, minlength=65536)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        length = np.array([len(d) for d in docs])
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.at, self.term, self.weight = np.concatenate([[0], np.cumsum(size)]), term, weight
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64) -> np.ndarray:
        """Unused documents that share terms with the seed, best first, at most ``most``;
        asked again when a window needs more."""
        own = slice(self.at[seed], self.at[seed + 1])
        t, w = self.term[own], self.weight[own]
        if len(t) > self.terms:  # the seed's own heaviest terms are the query
            t = t[np.argpartition(-w, self.terms)[:self.terms]]
        begin, size = self.first[t], self.first[t + 1] - self.first[t]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        score = np.bincount(self.post_doc[at], minlength=self.n, weights=self.post_weight[at])
        score[used] = 0
        best = np.argpartition(-score, most)[:most] if self.n > most else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


class Packer:
    """Fills windows over the shards of one partition; pieces are (doc_id, ids, start, stop)."""

    def __init__(self, part: int, window: int, terms: int):
        self.next_id, self.window, self.terms = part << 40, window, terms
        self.open: list[tuple] = []
        self.room = window
        self.done: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc_id, ids, start, stop in self.open:
            self.done.append((self.next_id, offset, doc_id, start, stop - start, len(ids),
                              ids[start:stop].astype("<u4").tobytes()))
            offset += stop - start
        self.next_id += 1
        self.open, self.room = [], self.window

    def _put(self, doc_id, ids: np.ndarray) -> bool:
        """Whether a window was closed on the way."""
        start, closed = 0, False
        while start < len(ids):
            stop = min(len(ids), start + self.room)
            self.open.append((doc_id, ids, start, stop))
            self.room -= stop - start
            start = stop
            if not self.room:
                self._close()
                closed = True
        return closed

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index = Shard(docs, self.terms)
        used = np.zeros(len(docs), bool)
        seed = None
        for i in range(len(docs)):
            if used[i]:
                continue
            seed = i
            used[i] = True
            closed = self._put(doc_ids[i], docs[i])
            while not closed or self.room < self.window:
                found = index.neighbours(seed, used)
                if not len(found):
                    break
                for j in found:
                    used[j] = True
                    closed = self._put(doc_ids[j], docs[j])
                    if closed:
                        seed = j  # its rest is in the next window
                        break

    def finish(self) -> None:
        """Cut what is open into powers of two."""
        rest, left = self.open, self.window - self.room
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            self.open = []
            while want:
                doc_id, ids, start, stop = rest[0]
                take = min(want, stop - start)
                self.open.append((doc_id, ids, start, start + take))
                rest = rest[1:] if take == stop - start else [(doc_id, ids, start + take, stop), *rest[1:]]
                want -= take
            self._close()

    def taken(self) -> pd.DataFrame:
        out, self.done = self.done, []
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        return frame.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, file: str | None = None, end_id: int = 2, window: int = WINDOW, terms: int = 32,
         shard_tokens: int = 1_500_000) -> DataFrame:
    """One row per piece: sequence_id, offset, doc_id, start, length, doc_tokens, and the
    piece's ids (binary, little-endian unsigned 32-bit)."""
    file = file or public_tokenizers.path("word_bpe_49k.json")
    dealt = tokenize(docs, file, end_id).repartition(F.xxhash64("doc_id", F.xxhash64("ids16")))
    dealt = dealt.sortWithinPartitions("doc_id", "ids16")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), window, terms)
        doc_ids, arrays, size = [], [], 0
        for pdf in batches:
            for doc_id, blob in zip(pdf["doc_id"], pdf["ids16"]):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                arrays.append(np.frombuffer(blob, "<u2"))
                size += len(arrays[-1])
                if size >= shard_tokens:
                    packer.shard(doc_ids, arrays)
                    doc_ids, arrays, size = [], [], 0
                    yield packer.taken()
        if arrays:
            packer.shard(doc_ids, arrays)
        packer.finish()
        yield packer.taken()

    return dealt.mapInPandas(run, PIECES)

"""Language identification by mixtures of character n-gram models.

Counts of hashed character trigrams per language are gathered over all labelled rows; a
document is a mixture of those models. Expectation-maximisation estimates the shares of
all languages from the likelihoods of the document's trigrams; languages are then taken in
by falling share for as long as the likelihood of the mixture, less ``penalty`` * log(n) for
each language, grows. The document's language is the one with the largest share among
those taken in, its score that language's share among all.

Null text, empty text and text without a letter give ``und`` and score 0, as does a model
that was fitted on no row. Null ids are ordinary ids with the text ''. Repeated rows count
each and are judged alike; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.common import whole_text

BITS = 16
UNKNOWN = "und"
SMOOTH = 0.5


def held_out(col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct trigram of each text: position of the text, hashed trigram, count.

    Letters are lower-cased, all else is a blank; each trigram is centred on a letter.
    """
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts).lower() + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.cumsum(c == 0, dtype=np.int32) - 1
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    mid = np.flatnonzero(letter)
    h = (c[mid - 1] * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA77)) ^ (c[mid + 1] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    key = (doc[mid].astype(np.int64) << BITS) | (h >> np.uint32(32 - BITS)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return key >> BITS, key & ((1 << BITS) - 1), count


def _portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters each, a longer text for itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class LanguageModel:
    """Languages and the probability of each hashed trigram in each of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts + SMOOTH
        self.prob = (counts / counts.sum(axis=0)).astype(np.float32)  # (trigrams, languages)

    @staticmethod
    def _em(prob, share, doc, count, start, total, rounds: int):
        for _ in range(rounds):
            r = prob * share[doc]
            r *= (count / np.maximum(r.sum(axis=1), 1e-30))[:, None]
            share = np.add.reduceat(r, start, axis=0) / total[:, None]
        return share

    @staticmethod
    def _fit_of(prob, share, doc, count, start):
        mix = np.maximum((prob * share[doc]).sum(axis=1), 1e-30)
        return np.add.reduceat(count * np.log(mix), start)

    def judge(self, texts: list[str], rounds: int = 8, penalty: float = 1.0):
        """Per text: language, score, languages taken in (by falling share)."""
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        taken: list[list[str]] = [[] for _ in texts]
        if not self.languages:
            return pred, score, taken
        doc, gram, count = trigrams(texts)
        if not len(doc):
            return pred, score, taken
        rows, start = np.unique(doc, return_index=True)
        doc = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(doc))))
        count = count.astype(np.float32)
        total = np.add.reduceat(count, start)
        prob, k = self.prob[gram], len(self.languages)
        share = self._em(prob, np.full((len(rows), k), 1 / k, np.float32), doc, count, start, total, rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        size = np.ones(len(rows), int)
        alone = np.stack([np.add.reduceat(count * np.log(prob[:, j]), start) for j in range(k)], axis=1)
        fit, lead = alone.max(axis=1), alone.argmax(axis=1)
        open_rows = np.arange(len(rows))
        for s in range(2, k + 1):  # only documents that took in all so far go on
            inside = np.zeros((len(rows), k), np.float32)
            np.put_along_axis(inside, order[:, :s], 1, axis=1)
            pick = np.zeros(len(rows), bool)
            pick[open_rows] = True
            use = pick[doc]
            sub_doc = np.searchsorted(open_rows, doc[use])
            sub_start = np.searchsorted(sub_doc, np.arange(len(open_rows)))
            begin = share[open_rows] * inside[open_rows] + 1e-9 * inside[open_rows]
            begin /= begin.sum(axis=1, keepdims=True)
            sub = (prob[use], begin, sub_doc, count[use], sub_start)
            mixed = self._em(*sub, total[open_rows], max(2, rounds // 2))
            value = self._fit_of(sub[0], mixed, *sub[2:])
            better = value - fit[open_rows] > penalty * np.log(total[open_rows] + 1) + 2
            open_rows = open_rows[better]
            if not len(open_rows):
                break
            size[open_rows] = s
            fit[open_rows] = value[better]
            lead[open_rows] = mixed[better].argmax(axis=1)
        for i, row in enumerate(rows):
            pred[row] = self.languages[lead[i]]
            score[row] = float(min(1.0, max(0.0, share[i, lead[i]])))
            taken[row] = ([pred[row]] if size[i] == 1 else
                          [self.languages[j] for j in order[i, :size[i]]])
        return pred, score, taken


def fit(docs: DataFrame, max_languages: int = 500, chars: int = 2_000_000) -> LanguageModel:
    """Model of all rows of (text, lang) with a language.

    Counts are summed per task, then by Spark; what reaches the driver is 2^16 counts for
    each language, and more than ``max_languages`` languages are an error.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                texts = list(group["_text"])
                for a, b in _portions(texts, chars):
                    _, gram, n = trigrams(texts[a:b])
                    own += np.bincount(gram, weights=n, minlength=1 << BITS).astype(np.int64)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": own[at]})

    rows = docs.where("lang is not null").select(F.col("lang").cast("string"), whole_text().alias("_text"))
    counted = rows.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    found = counted.orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((1 << BITS, len(found)))
    for j, r in enumerate(found):
        pairs = np.array(r["grams"], dtype=np.int64).reshape(-1, 2)
        counts[pairs[:, 0], j] = pairs[:, 1]
    return LanguageModel([r["lang"] for r in found], counts)


def identify(docs: DataFrame, model: LanguageModel, chars: int = 4_000_000) -> DataFrame:
    """The input's columns with lang_pred, score and languages; those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB for each language
    keep = docs.drop("lang_pred", "score", "languages")
    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("languages", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in _portions(texts, max(100_000, chars // max(1, len(model.languages)))):
                out = pdf.iloc[a:b].copy()
                out["lang_pred"], out["score"], out["languages"] = model.judge(texts[a:b])
                yield out

    return keep.mapInPandas(run, schema)

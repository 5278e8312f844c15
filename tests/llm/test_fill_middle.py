"""Fill-in-the-middle: cuts against slicing, texts back from what was written."""

import hashlib
import random
import re

from clausewise.llm import fill_middle
from pyspark.sql import functions as F


def test_descent_finds_every_unit():
    r = random.Random(3)
    for size in (0, 1, 2, 5, 40, 300):
        text = "".join(r.choice("ab é日𝄞\n") for _ in range(size))
        data = text.encode()
        begins = [m.start() for m in re.finditer(fill_middle.WORD, data)]
        words = [0, *begins[1:]] if begins else []
        for block in (1, 2, 7, 64, 4096):
            tree = fill_middle.FenwickBlocks(data, None, block)
            assert (tree.n_units, tree.n_points) == (len(text), len(text))
            assert [tree.cut(k) for k in range(len(text) + 1)] == [
                (len(text[:k].encode()), k) for k in range(len(text) + 1)]
            tree = fill_middle.FenwickBlocks(data, re.compile(fill_middle.WORD), block)
            assert [tree.cut(k) for k in range(len(words) + 1)] == [
                (b, len(data[:b].decode())) for b in [*words, len(data)]]


def brute(doc_id, text):
    """The rule by slicing."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    i, j = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:i], t[i:j], t[j:]
    if not t or any(x in t for x in fill_middle.MARKS) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


def check(df, **options):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    out = fill_middle.fill_in_middle(df, **options)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=key)
    assert sorted((tuple(r)[:6] for r in out), key=key) == want
    texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    assert sorted(map(repr, ((r["doc_id"], r["back"]) for r in out))) == sorted(map(repr, texts))
    return out


def test_all_documents(docs):
    assert {r["form"] for r in check(docs)} == {"plain", "psm", "spm"}
    check(docs, chars=500)


def test_odd_rows(odd, empty):
    check(odd)
    assert check(empty) == []


def test_marks_in_texts(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["<", ">", "P", "S", "M", "<P", "S>", "<M", "é", "\n"]) for _ in range(r.randint(0, 12)))
             for _ in range(400)] + ["has <M> inside", "<P", "<", ">", "<S<P<M"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["form"] for r in check(df)} == {"plain", "psm", "spm"}


def test_units_of_words(spark):
    text = " one two  three\n" * 50
    df = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(df, unit=fill_middle.WORD, plain_percent=0)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["n"] == 150 and r["back"] == text for r in out)
    for r in out:  # cuts fall where words begin
        at = r["prefix_chars"]
        assert at in (0, len(text)) or (text[at] not in " \n" and text[at - 1] in " \n")

import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def messy():
    """Rows that are null, empty, blank, long, repeated, nearly equal, or share passages."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, base, line = prose(70), prose(160), "This line is the same in very many of the documents here"
    texts = [None, "", " \n\t ", "one", "One two", "one two\x00three", "ends in a blank ", "  two  blanks  ",
             "ÉCOLE é 日本 ▁mark <|endoftext|> ½ \r\x0b tail", "a a a a a a a a a a a a a", base, base, base.upper(),
             prose(60) + " " + passage + " " + prose(40), passage + "\n" + prose(80), prose(30) + "\n" + passage,
             " ".join(vocabulary[i % 7] for i in range(3000)), prose(30_000)]
    for i in range(6):
        w = base.split()
        w[10 + 9 * i] = f"edit{i}"
        texts += [" ".join(w), prose(55 + i) + f"\n {line.upper() if i % 2 else line}\t\n" + prose(9)]
    rows = [(i, t, [None, "en", "fr"][i % 3], None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows(spark):
    """Distinct ids: the smallest documents and the messy ones behind them."""
    real = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return [tuple(r) for r in real] + [(1000 + r[0], *r[1:]) for r in messy()]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """A null id, repeated rows, and columns whose names the operators use themselves."""
    rows = [(r[0], *r[1:]) for r in messy()[:16]] + [messy()[10], messy()[10], (None, messy()[10][1], None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(
        ("_id", "_h", "_row", "_text", "kept", "n", "key", "_lines", "part", "_spans", "f", "comp"))])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

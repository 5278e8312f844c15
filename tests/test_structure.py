import random

from clausewise.operators import ordering, structure


def lines(spark, *texts):
    rows = [(d, i, l) for d, t in enumerate(texts) for i, l in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "doc_id int, line_no int, line string")


def ids(df):
    return [r["native_id"] for r in df.orderBy("doc_id", "seq").collect()]


def test_articles(spark):
    t = ("As Article 8(1) says\nCHAPTER I\n\nGeneral provisions\nArticle 1\n(3)\nSubject matter\n"
         "1. First part\ncontinues here\n2. Second part\nL 119/33\nArticle 2 \nScope\nWhole body\ntext")
    got = structure.extract_articles(lines(spark, t)).orderBy("seq").collect()
    assert [r["native_id"] for r in got] == ["Article 1.1", "Article 1.2", "Article 2"]
    assert got[0]["text"] == "First part continues here" and got[0]["title"] == "Subject matter"
    assert got[0]["hierarchy_path"] == ["CHAPTER I", "General provisions", "Article 1", "1"]
    assert got[2]["text"] == "Whole body text"


def test_numbered_clauses(spark):
    t = ("9.9 Old\nbody\n1 Scope\nscope text\n4.1 Context ..... 7\n4.1 Context\nintro\na) first\nmore\n"
         "b. second\nISO/IEC page\n4.2 Empty\n4.3 Needs\nbody")
    got = structure.extract_numbered_clauses(lines(spark, t))
    assert ids(got) == ["1", "4.1", "4.1.a", "4.1.b", "4.3"]


def test_subcategories_and_best(spark):
    t = "x\nID.IM-P4: Starts\nmore\nApril 1\nGV.RM-P2: Moved to elsewhere and on\nGV.RM-P2: Short"
    got = structure.extract_subcategories(lines(spark, t))
    assert ids(got) == ["ID.IM-P4", "GV.RM-P2", "GV.RM-P2"]
    best = {r["native_id"]: r["text"] for r in structure.best_records(got, prefer_active=True).collect()}
    assert best["GV.RM-P2"] == "Short"
    longest = {r["native_id"]: r["text"] for r in structure.best_records(got).collect()}
    assert longest["GV.RM-P2"] == "Moved to elsewhere and on"


def pack(body, max_bytes, max_lines):
    """Greedy packing of short lines, for comparison."""
    out, cur = [], []
    for l in [x.strip() for x in body.split("\n") if x.strip()]:
        if cur and (len("\n".join(cur + [l]).encode()) > max_bytes or len(cur) >= max_lines):
            out.append("\n".join(cur))
            cur = []
        cur.append(l)
    return out + (["\n".join(cur)] if cur else [])


def chunked(spark, body, b, n):
    df = spark.createDataFrame([("R", "s", "r::1", "1", body)], "regulation string, "
                               "source_document_id string, normalized_id string, native_id string, text string")
    return [r["text"] for r in structure.chunk_lines(df, b, n).orderBy("chunk_index").collect()]


def test_chunks(spark):
    body = "\n".join(["line-with-content"] * 120)
    got = chunked(spark, body, 128, 4)
    assert got == pack(body, 128, 4) and len(got) > 1
    rnd = random.Random(1)
    body = "\n".join("ü" * rnd.randint(1, 40) for _ in range(60))
    assert chunked(spark, body, 100, 5) == pack(body, 100, 5)


def test_long_lines_are_cut_and_nothing_is_lost(spark):
    body = "aa bb " + "é" * 30 + " cc\nshort"
    got = chunked(spark, body, 16, 3)
    assert all(len(c.encode()) <= 16 for c in got)
    assert "".join("".join(got).split()) == "".join(body.split())


def test_running_count_over_many_blocks(spark):
    rows = [(d, i, (i * 7 + d) % 3 == 0) for d in range(2) for i in range(100)]
    df = spark.createDataFrame(rows, "d int, i int, f boolean")
    got = {(r["d"], r["i"]): r["n"] for r in
           ordering.running_count(df, ["d"], "i", {"f": "n"}, block_rows=9).collect()}
    for d in range(2):
        n = 0
        for i in range(100):
            n += (i * 7 + d) % 3 == 0
            assert got[(d, i)] == n


def test_rank_and_index_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") * 3).alias("k"), (F.col("id") % 10 < 7).cast("int").alias("g"),
                                  F.md5(F.col("id").cast("string")).alias("h"))
    idx = ordering.row_index(df, "k", "i", blocks=16)
    assert idx.where("i * 3 <> k").count() == 0 and idx.count() == 5000
    got = ordering.rank_by_hash(df, ["g"], "h", "k", "r", "n").collect()
    for g in (0, 1):
        mine = sorted((r["h"], r["r"]) for r in got if r["g"] == g)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}


def test_lookup_with_a_hot_key(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 1, F.concat(F.lit("k"), F.col("id") % 50))
                                    .otherwise("hot").alias("token"))
    table = spark.createDataFrame([("hot", 9000, 1)] + [(f"k{i}", 1, i) for i in range(49)],
                                  "token string, w long, v int")
    got = ordering.lookup_skew_safe(rows, table, "token", "w", "id", ["v"])
    assert got.count() == 3000
    want = rows.join(table.select("token", "v"), "token", "left")
    assert sorted(map(str, got.select("id", "v").collect())) == sorted(map(str, want.select("id", "v").collect()))


def test_standard_files(spark):
    import pytest

    names = [("a/BS ISO-IEC 15944-12-2025.docx",), ("ISO_27001_Standard-1.docx",), ("GDPR ISO.docx",), ("iso.pdf",)]
    df = spark.createDataFrame(names, "file_name string")
    got = {r["output_stem"]: r["source_document_id"] for r in structure.standard_sources(df).collect()}
    assert got == {"iso15944_12": "iso-15944-12-2025", "iso27001": "iso-27001"}
    twice = df.unionByName(spark.createDataFrame([("ISO 27001-2013.docx",)], "file_name string"))
    with pytest.raises(Exception, match="duplicate output stem"):
        structure.standard_sources(twice).collect()


ARTICLES = ("As Article 8(1) says\nCHAPTER I\n\nGeneral provisions\nArticle 1\n(3)\nSubject matter\n"
            "1. First part\ncontinues here\n2. Second part\nL 119/33\nArticle 2 \nScope\nWhole body\ntext\nCHAPTER II\nArticle 3\n"
            "1. A title with a number\nbefore\n4. \n5. five\nArticle 4\nArticle 5\nOnly a title")
CLAUSES = ("9.9 Old\nbody\n1 Scope\nscope text\n4.1 Context ..... 7\n4.1 Context\nintro\na) first\nmore\n"
           "b. second\nISO/IEC page\n4.2 Empty\n4.3 Needs\nbody\nxii\nA.5.1 Last\n\nii) roman\n12: number")


def test_scans_agree_whatever_the_blocks(spark):
    """Sections, titles and parts that run over block edges."""
    texts = [ARTICLES, "", "Article 1", ARTICLES.replace("Article 1\n", "")]
    whole = sorted(map(str, structure.extract_articles(lines(spark, *texts)).collect()))
    assert len(whole) > 8
    for n in (1, 2, 5):
        assert sorted(map(str, structure.extract_articles(lines(spark, *texts), block_rows=n).collect())) == whole
    texts = [CLAUSES, "4 Only\nx", CLAUSES.replace("1 Scope", "none")]
    whole = sorted(map(str, structure.extract_numbered_clauses(lines(spark, *texts)).collect()))
    for n in (1, 3):
        assert sorted(map(str, structure.extract_numbered_clauses(lines(spark, *texts), block_rows=n).collect())) == whole


def test_chapters_titles_and_empty_articles(spark):
    got = structure.extract_articles(lines(spark, ARTICLES), block_rows=4).orderBy("seq").collect()
    assert [(r["native_id"], r["title"], r["text"], r["chapter"]) for r in got] == [
        ("Article 1.1", "Subject matter", "First part continues here", "CHAPTER I"),
        ("Article 1.2", "Subject matter", "Second part", "CHAPTER I"), ("Article 2", "Scope", "Whole body text", "CHAPTER I"),
        ("Article 3.5", "1. A title with a number", "five", "CHAPTER II"), ("Article 4", "Article 4", "", "CHAPTER II"),
        ("Article 5", "Only a title", "", "CHAPTER II")]


def test_scan_last_before_and_up_to(spark):
    from pyspark.sql import functions as F

    rows = [(d, i, (i * 5 + d) % 4 == 0) for d in range(2) for i in range(60)]
    for n in (1, 7, 100):
        df = ordering.in_blocks(spark.createDataFrame(rows, "d int, i int, f boolean"), ["d"], "i", n)
        at = F.when(F.col("f"), F.col("i"))
        got = ordering.scan_last(df, ["d"], "i", {"up": at, "ahead": at}, before=("ahead",)).collect()
        for r in got:
            mine = [i for d, i, f in rows if d == r["d"] and f and i <= r["i"]]
            assert r["up"] == max(mine, default=None)
            assert r["ahead"] == max([i for i in mine if i < r["i"]], default=None)


def split_to_fit(line, limit):
    """The stated rule for lines that are too long, in plain Python."""
    if len(line.encode()) <= limit:
        return [line]
    pieces, current = [], ""
    for token in line.split(" "):
        probe = f"{current} {token}" if current else token
        if len(probe.encode()) <= limit:
            current = probe
            continue
        if current:
            pieces.append(current)
        current = ""
        if len(token.encode()) <= limit:
            current = token
            continue
        for ch in token:
            if len((current + ch).encode()) > limit:
                pieces.append(current)
                current = ""
            current += ch
    return pieces + ([current] if current else [])


def test_chunks_of_odd_lines(spark):
    """Long tokens, runs of blanks, wide characters, against the rule in plain Python."""
    rnd = random.Random(7)
    for _ in range(12):
        body = "\n".join("".join(rnd.choice(["a", "é", "日", " ", "  ", "word", "x" * 30]) for _ in range(rnd.randint(0, 40)))
                         for _ in range(6))
        parts = [p for l in body.split("\n") if l.strip() for p in split_to_fit(l.strip(), 24)]
        want, active = [], []
        for p in parts:
            if active and (len("\n".join(active + [p]).strip().encode()) > 24 or len(active) >= 3):
                want.append("\n".join(active).strip())
                active = []
            active.append(p)
        want += ["\n".join(active).strip()] if active else []
        assert chunked(spark, body, 24, 3) == want


def test_chunk_metadata(spark):
    schema = ("regulation string, source_document_id string, normalized_id string, native_id string, text string, source_path string, "
              "chapter string, section string, clause string, metadata map<string,string>")
    df = spark.createDataFrame([("R", "s", "r::1", "1", "a\nb\nc", "p", "C", "S", "K", {"status": "moved", "section": "own"})], schema)
    got = [r["metadata"] for r in structure.chunk_lines(df, 100, 2).orderBy("chunk_index").collect()]
    assert got == [{"regulation": "R", "control_id": "r::1", "native_control_id": "1", "source_document_id": "s", "source_path": "p",
                    "chunk_index": str(i), "chapter": "C", "section": "own", "clause": "K", "status": "moved"} for i in range(2)]
    assert structure.chunk_lines(df.drop("metadata", "chapter")).first()["metadata"]["chapter"] == ""
    assert structure.chunk_lines(df.withColumn("text", df["source_path"].substr(9, 1))).count() == 0


def ordered(spark, rows, block_rows, blocks=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "lead long, tie string, v double").repartition(5)
    return ordering.OrderedBlocks(df, [F.col("lead"), F.col("tie")], block_rows, blocks)


def test_one_outlier_and_one_tie_for_half(spark):
    """An outlier key and a tie in the leading column for half of the rows: blocks stay small,
    places and predecessors are exact."""
    rnd = random.Random(3)
    rows = [(7 if i % 2 else rnd.randint(0, 500), f"t{i:05d}", None if i % 9 == 0 else i / 10) for i in range(4000)]
    rows.append((2 ** 62, "far", 1.0))
    want = sorted(rows, key=lambda r: r[:2])
    for block_rows, blocks in ((200, None), (200, 1), (100_000, None)):
        cut = ordered(spark, rows, block_rows, blocks)
        assert max(r["_n"] for r in cut.sizes.collect()) <= max(2 * block_rows, 400)
        assert (cut.sizes.count() > 8) == (block_rows == 200)
        got = sorted(cut.positions("at").collect(), key=lambda r: r["at"])
        assert [(r["at"], r["lead"], r["tie"], r["v"]) for r in got] == [(i, *r) for i, r in enumerate(want)]
        before = {(r["lead"], r["tie"]): r["b"] for r in cut.previous(["tie", "v"], "b").collect()}
        for earlier, r in zip([None, *want], want):
            b = before[r[:2]]
            assert (b is None) if earlier is None else (b["tie"], b["v"]) == earlier[1:]


def test_trend_over_block_edges(spark):
    from clausewise.operators import gates

    rows = [("hot" if i % 3 else "cold", f"2026-01-{i % 28 + 1:02d}", f"r{i:03d}", i / 7 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "model_type string, executed_at string, name string, test_macro_f1 double").repartition(4)
    got = {r["name"]: r["change"] for r in gates.run_trend(df, block_rows=20).collect()}
    for series in ("hot", "cold"):
        last = None
        for r in sorted((r for r in rows if r[0] == series), key=lambda r: r[1:3]):
            want = None if last is None or last[3] is None or r[3] is None else round(r[3] - last[3], 6)
            assert got[r[2]] == want if want is None else abs(got[r[2]] - want) < 1e-6
            last = r


def test_short_documents_are_read_once_and_long_ones_in_blocks(spark):
    lines = []
    for d, n in ((1, 12), (2, 60), (3, 7)):
        for i in range(n):
            lines.append((d, i, ("CHAPTER I", "Things", "Article 1 ", "Title", "1. One", "more", "ID.IM-P1: Starts", "2. Two",
                                 "1 Scope", "4.1 Name", "a) Bullet", "")[(i * (d + 4)) % 12]))
    df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    with_nulls = df.unionByName(spark.createDataFrame([(None, 1, "Article 1"), (4, None, "Article 2")], df.schema))
    for extract in (structure.extract_articles, structure.extract_subcategories, structure.extract_numbered_clauses):
        whole = extract(df)
        told = lambda r: sorted(map(str, r.drop("metadata").collect()))
        assert told(whole) and told(whole) == told(extract(df, block_rows=20)) == told(extract(df, block_rows=3))
        assert told(whole) == told(extract(with_nulls))
        # No document has several blocks, so none is joined with summaries of its blocks.
        assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_every_kind_of_white_space(spark):
    from clausewise.functions import text

    kinds = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    rows = [(f"{a}{b} x{a} y{b}{a}", f"x{a} y") for a in kinds for b in ("", " ", "\n")] + [("".join(kinds), ""), ("", ""), ("\u200bz ", "\u200bz")]
    df = spark.createDataFrame(rows, "t string, want string").select(text.strip("t").alias("got"), "want", text.normalize_space("t").alias("n"))
    for r in df.collect():
        assert r["got"] == r["want"] and r["n"] == " ".join(r["got"].split())
    assert "regexp_replace" not in str(text.strip("t"))


def test_chunk_bounds_of_documents_without_chunks(spark, tmp_path):
    import duckdb

    from clausewise.plans import q_structure

    texts = [None, "", " \n\t ", "\x0b", "a\x0bb", "a\x85b c", "x\x1cy\x1fz\x1f", "\u00a0a\u3000\n\u3000", "\u2003 " * 400,
             "\u00e9\u00a0" * 500, "y" * 1300, "a" + " " * 700 + "b", "a\r\nb\r\rc\n"]
    rows = [(i, t, "web", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in q_structure.chunk_bounds(spark, str(tmp_path)).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(q_structure.ORACLE["chunk_bounds"]).fetchall())

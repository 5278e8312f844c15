"""Regulation texts, one line per row, into control records.

Input of every extractor: (doc_id, line_no, line). Headers are flagged per line, a
running count of headers numbers the sections, and sections are aggregated. The
running counts are block-wise (see ``ordering.running_count``), so one very long
document does not end up in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import text
from clausewise.functions.records import LINE_BREAK
from clausewise.operators.ordering import by_length, guard_unions, in_blocks, running_count, scan_last


def _any_of(words, where: str) -> str:
    body = "|".join(re.escape(w) for w in words)
    return f"^(?:{body})" if where == "prefix" else body


def is_noise(line, profile: str) -> Column:
    """Page furniture of a profile (articles, clauses, subcategories); blanks too.

    The article rule drops every line that contains ``EN`` anywhere.
    """
    c = text.col(line)
    if profile == "articles":
        hit = c.rlike(_any_of(lexicon.ARTICLE_NOISE_CONTAINS, "any")) | c.rlike(
            f"^{lexicon.ARTICLE_NOISE_FULL}$")
    elif profile == "subcategories":
        hit = c.rlike(_any_of(lexicon.SUBCATEGORY_NOISE_PREFIXES, "prefix")) | c.rlike(
            f"^{lexicon.SUBCATEGORY_NOISE_FULL}$")
    elif profile == "clauses":
        hit = c.rlike(_any_of(lexicon.CLAUSE_NOISE_PREFIXES, "prefix")) | F.lower(c).rlike(
            f"^{lexicon.CLAUSE_NOISE_FULL}$")
    else:
        raise ValueError(f"unknown profile '{profile}'")
    return (c == "") | hit


def drop_noise_lines(lines: DataFrame, profile: str, column: str = "line") -> DataFrame:
    return lines.where(~is_noise(text.strip(column), profile))


def is_toc(line) -> Column:
    """Table-of-contents line: four or more dots in a row."""
    return text.col(line).rlike(r"\.{4,}")


def drop_toc_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.where(~is_toc(column))


def _scope(clean: Column) -> Column:
    return clean.rlike(r"(?i)^1[.)\s]+Scope\s*$") & ~is_toc(clean)


def body_start(lines: DataFrame) -> DataFrame:
    """Lines from the first ``1 Scope`` heading on; all lines where there is none."""
    starts = lines.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(_scope(text.strip_invisible("line")), F.col("line_no"))), F.lit(0)).alias("_start"))
    return lines.join(starts, "doc_id").where(F.col("line_no") >= F.col("_start")).drop("_start")


def _body_blocks(blocks: DataFrame, cut: bool) -> DataFrame:
    """The same for rows of in_blocks with ``clean``: starts come from one row per block;
    without ``cut`` from the document's only one."""
    if not cut:
        start = F.min(F.when(_scope(F.col("clean")), F.col("line_no"))).over(Window.partitionBy("doc_id", "_block"))
        return blocks.withColumn("_start", F.coalesce(start, F.lit(0))).where(F.col("line_no") >= F.col("_start")).drop("_start")
    starts = blocks.groupBy("doc_id", "_block").agg(F.min(F.when(_scope(F.col("clean")), F.col("line_no"))).alias("_s"))
    starts = starts.select("doc_id", "_block", F.coalesce(
        F.min("_s").over(Window.partitionBy("doc_id")), F.lit(0)).alias("_start"))
    return blocks.join(starts, ["doc_id", "_block"]).where(F.col("line_no") >= F.col("_start")).drop("_start")


def _joined(value, order: str = "line_no", sep: str = " ") -> Column:
    """Values of a group in line order, as one string."""
    items = F.array_sort(F.collect_list(F.struct(order, text.col(value).alias("v"))))
    return F.array_join(F.transform(items, lambda x: x["v"]), sep)


def _record(df: DataFrame, regulation: Column, confidence: float, profile: str,
            source_document_id: Column) -> DataFrame:
    """Common record columns; text and title normalized, ids from their content."""
    out = df.withColumn("title", text.normalize_space("title")).withColumn(
        "text", text.normalize_space("text"))
    return out.select(
        "doc_id",
        text.stable_hash(F.concat_ws(":", regulation, "native_id", "text")).alias("record_id"),
        regulation.alias("regulation"), source_document_id.alias("source_document_id"),
        "native_id", text.normalized_id(regulation, "native_id").alias("normalized_id"),
        "title", "text", F.filter("hierarchy_path", lambda h: h != "").alias("hierarchy_path"),
        "chapter", "section", "clause", F.lit(confidence).alias("parser_confidence"),
        F.create_map(F.lit("format_profile"), F.lit(profile), F.lit("status"),
                     F.col("status")).alias("metadata"),
        F.col("seq"))


def _parts(rows: DataFrame, section: dict[str, Column], part: Column, number: Column, body: Column,
           piece: Column) -> DataFrame:
    """Lines of in_blocks into one row per section: its columns and ``_parts``, an array of
    (at, number, pieces, lines, seq) in order; ``at`` is null before the first opener.

    Lines are gathered inside their block first; what moves once more are whole parts.
    """
    line = F.when(body, F.struct(F.col("line_no").alias("no"), piece.alias("piece"), F.col("line").alias("line")))
    inner = rows.withColumns({"_sec": section["at"], "_at": part, "_number": number}).groupBy(
        "doc_id", "_block", "_sec", "_at").agg(
        F.max("_number").alias("_number"), F.array_sort(F.collect_list(line)).alias("_lines"),
        *[F.max(c).alias(n) for n, c in section.items() if n != "at"])
    names = [n for n in section if n != "at"]
    inner = inner.repartition("doc_id", "_sec")
    whole = inner.groupBy("doc_id", "_sec", "_at").agg(
        F.max("_number").alias("number"), F.array_sort(F.flatten(F.collect_list("_lines"))).alias("lines"),
        *[F.max(n).alias(n) for n in names])
    one = F.struct(F.col("_at").alias("at"), "number", F.transform("lines", lambda x: x["piece"]).alias("pieces"),
                   F.transform("lines", lambda x: x["line"]).alias("lines"), F.get("lines", F.lit(0))["no"].alias("seq"))
    return whole.groupBy("doc_id", "_sec").agg(
        F.sort_array(F.collect_list(one)).alias("_parts"), *[F.max(n).alias(n) for n in names])


def extract_articles(lines: DataFrame, regulation: str = "GDPR",
                     source_document_id: str = "gdpr-2016_679", block_rows: int = 50_000) -> DataFrame:
    """``CHAPTER R`` / ``Article N`` headed text into articles and numbered sub-clauses.

    A scan in two steps over blocks of lines: which header and which chapter each line is
    under and whether it is the first after a header; then the titles and open sub-clauses.
    """
    # Header and sub-clause patterns.
    chapter = F.regexp_extract("line", r"^CHAPTER\s+([IVXLC]+)$", 1)
    article = F.regexp_extract("line", r"^Article\s+(\d+)$", 1)
    opener = r"^(\d+)\.\s+(.*)$"

    def sections(rows: DataFrame, cut: bool) -> DataFrame:
        base = in_blocks(rows.select("doc_id", "line_no", text.strip("line").alias("line")), ["doc_id"], "line_no", block_rows)
        base = base.withColumns({"_chapter": chapter, "_article": article, "_noise": is_noise("line", "articles"),
                                 "_num": F.regexp_extract("line", opener, 1)})
        is_chapter, is_article = F.col("_chapter") != "", F.col("_article") != ""
        header = is_chapter | is_article
        usable, told = ~header & ~F.col("_noise"), ~header & (F.col("line") != "")
        first = scan_last(base, ["doc_id"], "line_no", {
            "_head": F.when(header, F.struct(F.col("line_no").alias("at"), F.col("_article").alias("article"))),
            "_chap": F.when(is_chapter, F.col("_chapter")),
            "_after_article": F.when(header | usable, is_article),
            "_after_chapter": F.when(header | told, is_chapter)}, before=("_after_article", "_after_chapter"), cut=cut)
        title, chapter_title = usable & F.col("_after_article"), told & F.col("_after_chapter")
        none = lambda t: F.lit(None).cast(t)
        inside = F.col("_head.article") != ""
        second = scan_last(first, ["doc_id"], "line_no", {
            "_title": F.when(header, F.struct(none("string").alias("line"))).when(title, F.struct("line")),
            "_ctitle": F.when(is_chapter, F.lit("")).when(chapter_title, F.col("line")),
            "_part": F.when(header | title, F.struct(none("bigint").alias("at"), none("string").alias("number")))
            .when(usable & inside & (F.col("_num") != ""), F.struct(F.col("line_no").cast("bigint").alias("at"), F.col("_num").alias("number")))}, cut=cut)
        rows = second.where(inside & (is_article | usable))
        body = usable & ~F.coalesce(title, F.lit(False))
        piece = F.when(F.col("_num") != "", F.regexp_extract("line", opener, 2)).otherwise(F.col("line"))
        return _parts(rows, {
            "at": F.col("_head.at"), "article": F.col("_head.article"), "title": F.col("_title.line"),
            "chapter": F.concat(F.lit("CHAPTER "), F.col("_chap")), "chapter_title": F.col("_ctitle")},
            F.col("_part.at"), F.col("_part.number"), body, piece)

    made = split_subclauses(by_length(lines, ["doc_id"], "line_no", block_rows, sections)).select(
        "doc_id", "_sec", "article", "title", F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), "sub.*")
    whole = F.concat(F.lit("Article "), F.col("article"))
    native = F.concat(whole, F.coalesce(F.concat(F.lit("."), "sub_id"), F.lit("")))
    made = made.select(
        "doc_id", native.alias("native_id"), F.coalesce("title", whole).alias("title"), F.col("sub_text").alias("text"),
        F.array("chapter", "chapter_title", whole, F.coalesce("sub_id", F.lit(""))).alias("hierarchy_path"),
        "chapter", whole.alias("section"), native.alias("clause"), F.lit("active").alias("status"),
        F.coalesce("sub_seq", F.col("_sec")).alias("seq"))
    return _record(made, F.lit(regulation), 0.95, "article_subclause", F.lit(source_document_id))


def split_subclauses(sections: DataFrame) -> DataFrame:
    """Rows of _parts() into one row per sub-clause, ``sub`` (sub_id, sub_text, sub_seq).

    Lines before the first opener and sub-clauses without text are dropped; a section that
    has no other is one row with a null ``sub_id`` and all its lines.
    """
    told = F.transform("_parts", lambda p: F.struct(
        p["number"].alias("sub_id"), text.strip(F.array_join(p["pieces"], " ")).alias("sub_text"), p["seq"].alias("sub_seq"),
        p["at"].isNotNull().alias("opened")))
    good = F.transform(F.filter(told, lambda p: p["opened"] & (p["sub_text"] != "")), lambda p: F.struct(
        p["sub_id"].alias("sub_id"), p["sub_text"].alias("sub_text"), p["sub_seq"].alias("sub_seq")))
    d = sections.withColumn("_good", good)
    lines = F.array_join(F.flatten(F.transform("_parts", lambda p: p["lines"])), "\n")
    unsplit = F.array(F.struct(F.lit(None).cast("string").alias("sub_id"), lines.alias("sub_text"),
                               F.array_min(F.transform("_parts", lambda p: p["seq"])).alias("sub_seq")))
    subs = F.when(F.size("_good") > 0, F.col("_good")).otherwise(unsplit)
    return text.unfold(d.withColumn("_subs", subs).drop("_parts", "_good"), "_subs", "_pos", "sub").drop("_pos")


_CLAUSE = r"^((?:[1-9]\d*)(?:\.[0-9]+){0,4}|A\.[0-9]+(?:\.[0-9]+)?)\s+(.+)$"
_BULLET = r"^([A-Za-z]|[ivxIVX]+|\d{1,2})\)\s*;?\s+(.*)$"
_ALT_BULLET = r"^([A-Za-z]|[ivxIVX]+|\d{1,2})[.:]\s+(.*)$"


def extract_numbered_clauses(lines: DataFrame, regulation: str = "ISO27001",
                             source_document_id: str = "iso-27001", block_rows: int = 50_000) -> DataFrame:
    """``4.1 Title`` clauses and their ``a)`` bullets; text before bullets on its own."""
    def sections(rows: DataFrame, cut: bool) -> DataFrame:
        base = in_blocks(rows.select("doc_id", "line_no", text.strip_invisible("line").alias("clean"),
                                      text.strip("line").alias("line")), ["doc_id"], "line_no", block_rows)
        base = _body_blocks(base, cut).where(~is_noise("clean", "clauses"))
        base = base.withColumn("_id", F.when(~is_toc("clean"), F.regexp_extract("clean", _CLAUSE, 1)).otherwise(""))
        header = F.col("_id") != ""
        body = ~header & ~is_noise("line", "clauses")
        marked = F.regexp_extract("line", _BULLET, 1)
        other = F.regexp_extract("line", _ALT_BULLET, 1)
        base = base.withColumns({"_bullet": F.when(body & (marked != ""), marked).when(body & (other != ""), other),
                                 "_piece": F.when(marked != "", F.regexp_extract("line", _BULLET, 2)).when(
                                     other != "", F.regexp_extract("line", _ALT_BULLET, 2)).otherwise(F.col("line"))})
        opens = F.col("_bullet").isNotNull()
        none = lambda t: F.lit(None).cast(t)
        found = scan_last(base, ["doc_id"], "line_no", {
            "_head": F.when(header, F.struct(F.col("line_no").alias("at"), F.col("_id").alias("clause_id"), text.normalize_space(
                F.regexp_extract("clean", _CLAUSE, 2)).alias("clause_title"))),
            "_part": F.when(header, F.struct(none("bigint").alias("at"), none("string").alias("number")))
            .when(opens, F.struct(F.col("line_no").cast("bigint").alias("at"), F.col("_bullet").alias("number")))}, cut=cut)
        return _parts(found.where(F.col("_head").isNotNull() & body), {
            "at": F.col("_head.at"), "clause_id": F.col("_head.clause_id"), "clause_title": F.col("_head.clause_title")},
            F.col("_part.at"), F.col("_part.number"), F.lit(True), F.col("_piece"))

    texts = text.unfold(by_length(lines, ["doc_id"], "line_no", block_rows, sections), "_parts", "_pos", "p").select(
        "doc_id", "clause_id", "clause_title", F.col("p.number").alias("bullet"), F.col("p.seq").alias("seq"),
        text.normalize_space(F.array_join("p.pieces", " ")).alias("text")).where(F.col("text") != "")
    native = F.concat_ws(".", "clause_id", "bullet")
    chapter = F.split_part(native, F.lit("."), F.lit(1))
    made = texts.select(
        "doc_id", native.alias("native_id"),
        F.when(F.col("bullet").isNull(), F.col("clause_title")).otherwise(
            F.concat("clause_title", F.lit(" ("), "bullet", F.lit(")"))).alias("title"),
        "text", F.array(chapter, F.col("clause_id"), native).alias("hierarchy_path"),
        chapter.alias("chapter"), F.col("clause_id").alias("section"), native.alias("clause"),
        F.lit("active").alias("status"), "seq")
    return _record(made, F.lit(regulation), 0.92, "clause_bullet", F.lit(source_document_id))


def extract_subcategories(lines: DataFrame, regulation: str = "NISTPF",
                          source_document_id: str = "nist-pf-1.1", block_rows: int = 50_000) -> DataFrame:
    """``XX.YY-Pn: text`` entries with their continuation lines."""
    pattern = r"^([A-Z]{2}\.[A-Z]{2}-P\d+)\s*:\s*(.+)$"

    def sections(rows: DataFrame, cut: bool) -> DataFrame:
        base = rows.select("doc_id", "line_no", text.strip("line").alias("line"))
        base = base.where(~is_noise("line", "subcategories"))
        base = base.withColumn("_id", F.regexp_extract("line", pattern, 1))
        base = base.withColumn("_header", F.col("_id") != "")
        return running_count(base, ["doc_id"], "line_no", {"_header": "_sec"}, block_rows, cut).where("_sec > 0")

    numbered = by_length(lines, ["doc_id"], "line_no", block_rows, sections)
    piece = F.when(F.col("_header"), F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
    texts = numbered.withColumn("_piece", piece).groupBy("doc_id", "_sec").agg(
        F.max("_id").alias("native_id"), text.normalize_space(_joined("_piece")).alias("text"),
        F.min("line_no").alias("seq")).where(F.col("text") != "")
    family = F.split_part("native_id", F.lit("."), F.lit(1))
    category = F.split_part("native_id", F.lit("-"), F.lit(1))
    made = texts.select(
        "doc_id", "native_id", F.col("native_id").alias("title"), "text",
        F.array(family, category, F.col("native_id")).alias("hierarchy_path"),
        family.alias("chapter"), category.alias("section"), F.col("native_id").alias("clause"),
        text.subcategory_status("text").alias("status"), "seq")
    return _record(made, F.lit(regulation), 0.9, "subcategory", F.lit(source_document_id))


def best_records(records: DataFrame, key: list[str] = ("doc_id", "normalized_id"),
                 prefer_active: bool = False) -> DataFrame:
    """One record per id: the longest text, the first on a tie.

    ``prefer_active`` ranks active entries before moved ones whatever their length.
    An aggregate with partial sums of one row per key, not a window over all copies.
    """
    moved = (F.col("metadata")["status"] == "moved").cast("int") if prefer_active else F.lit(0)
    rank = F.struct(moved.alias("m"), (-F.length("text")).alias("l"), F.col("seq").alias("s"))
    others = [c for c in records.columns if c not in key]
    best = F.min_by(F.struct(*others), rank).alias("r")
    return records.groupBy(*key).agg(best).select(*key, "r.*")


def union_all_regulations(tables: list[DataFrame]) -> DataFrame:
    """Records of all regulations as one table, in the order given: ``seq`` keeps each
    table's own order behind its place in the list. A record id may occur in several."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("seq", F.struct(F.lit(i).alias("source"), F.col("seq").cast("bigint").alias("seq")))
        out = t if out is None else guard_unions(out).unionByName(t)
    return out


def standard_sources(files: DataFrame, column: str = "file_name") -> DataFrame:
    """Regulation, document id and output stem of the standards among file names.

    Two files with the same stem fail the query.
    """
    name = F.regexp_extract(column, r"([^/]*)$", 1)
    upper = F.upper(name)
    wanted = files.where(F.lower(name).endswith(".docx") & upper.contains("ISO")
                         & ~upper.contains("GDPR") & ~upper.contains("NIST"))
    family, year = text.standard_family(column), text.standard_year(column)
    key = F.translate(family, "-", "_")
    made = wanted.select(
        F.col(column).alias("file_name"), F.concat(F.lit("ISO"), key).alias("regulation"),
        F.concat(F.lit("iso"), key).alias("output_stem"),
        F.concat_ws("-", F.lit("iso"), F.lower(family), year).alias("source_document_id"))
    per_stem = made.groupBy("output_stem").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("file_name", "regulation",
                                                      "source_document_id")).alias("r"))
    stem = F.when(F.col("_n") > 1, F.raise_error(F.concat(
        F.lit("duplicate output stem "), "output_stem")).cast("string")).otherwise(
        F.col("output_stem"))
    return per_stem.select("r.file_name", "r.regulation", stem.alias("output_stem"),
                           "r.source_document_id")


# --- chunks -----------------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cuts(sizes: Column, limit: int, most: int) -> Column:
    """First positions of the groups that pack sizes greedily, one separator between two.

    ``sizes``: (full, tail, lead, alone) bytes of each item: in whole, without white space at
    its end, white space at its start, and whether it must open a group. The fold holds
    numbers only: the sum so far takes the place of the text.
    """
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"), F.lit(0).alias("bytes"),
                     F.lit(0).alias("lead"), F.lit(0).alias("n"))

    def step(s, x):
        glue = F.when(s["bytes"] == 0, 0).otherwise(1)
        fits = (s["n"] > 0) & ~x["alone"] & (s["n"] < most) & (s["bytes"] + glue + x["tail"] - s["lead"] <= limit)
        return F.when(fits, F.struct(s["cuts"].alias("cuts"), (s["i"] + 1).alias("i"), (s["bytes"] + glue + x["full"]).alias("bytes"),
                                     s["lead"].alias("lead"), (s["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(s["cuts"], F.array(s["i"])).alias("cuts"), (s["i"] + 1).alias("i"), x["full"].alias("bytes"),
                     x["lead"].alias("lead"), F.lit(1).alias("n")))

    return F.aggregate(sizes, start, step, lambda s: s["cuts"])


def _groups(items: Column, cuts: Column, sep: str) -> Column:
    """Items from each cut to the next, joined."""
    last = F.size(items)
    return F.transform(cuts, lambda c, k: F.array_join(F.slice(
        items, c + 1, F.coalesce(F.get(cuts, k + 1), last) - c), sep))


def _size(full: Column, tail: Column | None = None, lead: Column | None = None, alone: Column | None = None) -> Column:
    return F.struct(full.alias("full"), (full if tail is None else tail).alias("tail"),
                    (F.lit(0) if lead is None else lead).alias("lead"), (F.lit(False) if alone is None else alone).alias("alone"))


def _split_line(line: Column, limit: int) -> Column:
    """A line that is too long, cut at spaces, then between characters."""
    def pieces(tokens):
        # A token that is too long stands alone from its first piece on.
        items = F.flatten(F.transform(tokens, lambda t: F.when(F.octet_length(t) <= limit, F.array(
            F.struct(t.alias("t"), F.lit(False).alias("alone")))).otherwise(
            F.transform(_cut_long(t, limit), lambda p: F.struct(p.alias("t"), F.lit(True).alias("alone"))))))
        return _let(items, lambda its: _let(
            _cuts(F.transform(its, lambda x: _size(F.octet_length(x["t"]), alone=x["alone"])), limit, 1 << 30),
            lambda cuts: F.filter(F.transform(_groups(F.transform(its, lambda x: x["t"]), cuts, " "),
                                              lambda p: F.ltrim(p)), lambda p: p != "")))
    return F.when(F.octet_length(line) <= limit, F.array(line)).otherwise(_let(F.split(line, " "), pieces))


def _cut_long(token: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` bytes, cut between characters. Where every character has
    one byte the cuts are known beforehand."""
    plain = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(token) - 1) / limit).cast("int")),
                        lambda i: F.substring(token, i * limit + 1, F.lit(limit)))
    return F.when(F.octet_length(token) == F.char_length(token), plain).otherwise(_cut_chars(token, limit))


def _cut_chars(token: Column, limit: int) -> Column:
    """Characters are packed with nothing between them."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"), F.lit(0).alias("bytes"))

    def step(s, ch):
        b = F.octet_length(ch)
        return F.when((s["i"] > 0) & (s["bytes"] + b <= limit), F.struct(
            s["cuts"].alias("cuts"), (s["i"] + 1).alias("i"), (s["bytes"] + b).alias("bytes"))).otherwise(F.struct(
                F.concat(s["cuts"], F.array(s["i"])).alias("cuts"), (s["i"] + 1).alias("i"), b.alias("bytes")))

    return _let(F.split(token, ""), lambda chars: _let(
        F.aggregate(chars, start, step, lambda s: s["cuts"]), lambda cuts: _groups(chars, cuts, "")))


#: What a chunk says of its record, beside the record's own metadata.
CHUNK_METADATA = ("regulation", "control_id", "native_control_id", "source_document_id", "source_path", "chunk_index",
                  "chapter", "section", "clause")


def chunk_lines(records: DataFrame, max_bytes: int = 16 * 1024, max_lines: int = 40) -> DataFrame:
    """Pack the lines of each record into chunks of bounded bytes and lines.

    Cut positions are worked out from the lines' bytes, texts are put together once. All of
    it runs inside the record's row; records are never grouped or shuffled.
    """
    if max_bytes < 4:
        raise ValueError("max_bytes must hold at least one character (4 bytes)")
    lines = F.filter(F.transform(F.split("text", LINE_BREAK), text.strip), lambda l: l != "")
    parts = F.flatten(F.transform(lines, lambda l: _split_line(l, max_bytes)))
    packed = records.withColumn("_parts", parts)
    sizes = F.transform("_parts", lambda p: _size(
        F.octet_length(p), F.octet_length(F.regexp_replace(p, r"\s+$", "")),
        F.octet_length(p) - F.octet_length(F.regexp_replace(p, r"^\s+", ""))))
    packed = packed.withColumn("_cuts", _cuts(sizes, max_bytes, max_lines))
    packed = packed.withColumn("_chunks", F.transform(_groups(F.col("_parts"), F.col("_cuts"), "\n"), text.strip))
    keep = [c for c in ("doc_id", "regulation", "source_document_id") if c in records.columns]
    said = {"control_id": "normalized_id", "native_control_id": "native_id"}
    known = [F.col(said.get(k, k)).cast("string") if said.get(k, k) in records.columns else F.lit("") for k in CHUNK_METADATA]
    own = F.col("metadata") if "metadata" in records.columns else F.create_map().cast("map<string,string>")
    about = F.map_from_arrays(F.array(*[F.lit(k) for k in CHUNK_METADATA]), F.array(*known))
    flat = text.unfold(packed.select(*keep, F.col("normalized_id").alias("control_id"), about.alias("_about"), own.alias("_own"),
                                     "_chunks"), "_chunks", "chunk_index", "text")
    key = F.concat_ws(":", "control_id", F.col("chunk_index").cast("string"), "text")
    about = F.transform_values("_about", lambda k, v: F.when(k == "chunk_index", F.col("chunk_index").cast("string")).otherwise(v))
    metadata = F.map_concat(F.map_filter(about, lambda k, v: ~F.map_contains_key("_own", k)), F.col("_own"))
    return flat.select(text.stable_hash(key).alias("chunk_id"), *keep, "control_id", "chunk_index", "text",
                       metadata.alias("metadata"))

"""Quality rules with thresholds learned per language and source.

Rates of every document (word length, symbols, capitals, repeated lines, repeated words)
are summarised by mergeable quantile sketches per (lang, source); a document goes when a
rate lies outside its group's fence, q75 + 3 * max(q75 - q25, least spread) (and the
mirrored lower fence for word length). A group with fewer than ``support`` documents takes
the merged sketches of its language, a small language those of all documents. All of it is
DataFrame functions.

Null text has no words and fails; null lang or source is a group of its own; repeated rows
each count and get the same verdict; an empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import WHITE, lookup, materialize, row_keys, whole_rows, whole_text

#: Least spread of each rate: a fence is never nearer to its quartile than three times this.
LEAST_SPREAD = {"word_length": 0.4, "symbol_rate": 0.05, "capital_rate": 0.1,
                "dup_line_rate": 0.1, "repeat_rate": 0.1}
MIN_WORDS = 50
SKETCH_K = 800
NONE = "\u0000none"


def measure(docs: DataFrame) -> DataFrame:
    """Counts of each row: doc_id, _id, _h, _lang, _source and the base counts.

    Equal three-word windows are found by sorting 64-bit hashes within the row.
    """
    d = row_keys(docs).select(
        "doc_id", "_id", "_h",
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("_source"),
        whole_text().alias("_text"))
    d = d.withColumns({
        "_words": F.array_remove(F.split("_text", f"[{WHITE}]+"), ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long")})
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))})
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])) | (
        F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_found", F.sort_array(F.array_compact(F.transform(
        "_sorted", lambda x, i: F.when(same(x, i), x["i"])))))
    covered = F.aggregate(
        "_found", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))
    return d.select("doc_id", "_id", "_h", "_lang", "_source", "n_words", "word_chars", "n_symbols",
                    "n_capitals", "n_lines", "n_dup_lines",
                    F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def _rates() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    return {"word_length": over("word_chars", "n_words"), "symbol_rate": over("n_symbols", "n_words"),
            "capital_rate": over("n_capitals", "word_chars"), "dup_line_rate": over("n_dup_lines", "n_lines"),
            "repeat_rate": over("n_repeat_words", "n_words")}


def thresholds(measured: DataFrame, support: int = 100) -> DataFrame:
    """Fences of every (_lang, _source): lo_word_length and hi_* columns.

    The sketches merge: those of a language and of all documents come from the groups'
    own, without another pass. Documents too short to judge are left out.
    """
    rates = list(LEAST_SPREAD)
    use = measured.where(F.col("n_words") >= MIN_WORDS)
    groups = use.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"), *[
        F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in rates])
    groups = materialize(groups)  # sketches draw random bits; all levels must see the same ones

    def merged(g, name):
        return g.agg(F.sum("n").alias(f"{name}_n"), *[
            F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(f"{name}_{r}") for r in rates])

    by_lang = merged(groups.groupBy("_lang"), "lang")
    every = merged(groups.groupBy(), "every")
    t = groups.join(by_lang, "_lang").withColumn("_every", every.select(F.struct(*every.columns)).scalar())
    level = lambda r: F.when(F.col("n") >= support, F.col(r)).when(
        F.col("lang_n") >= support, F.col(f"lang_{r}")).otherwise(F.col(f"_every.every_{r}"))
    t = t.select("_lang", "_source", *[F.kll_sketch_get_quantile_double(level(r), F.lit(q)).alias(f"{p}_{r}")
                                       for r in rates for p, q in (("q1", 0.25), ("q3", 0.75))])
    reach = lambda r: 3 * F.greatest(F.col(f"q3_{r}") - F.col(f"q1_{r}"), F.lit(LEAST_SPREAD[r]))
    return t.select("_lang", "_source", *[(F.col(f"q3_{r}") + reach(r)).alias(f"hi_{r}") for r in rates],
                    (F.col("q1_word_length") - reach("word_length")).alias("lo_word_length"))


def judge(docs: DataFrame, support: int = 100) -> DataFrame:
    """Every row with its counts, base_failed and kept; keeps _id and _h for joins."""
    measured = materialize(measure(docs).withColumns(_rates()))
    fences = materialize(thresholds(measured, support))
    j = lookup(measured, fences, ["_lang", "_source"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("word_length") >= F.col("lo_word_length")
    for r in LEAST_SPREAD:
        inside = inside & (F.col(r) <= F.col(f"hi_{r}"))
    return (j.withColumn("base_failed", failed)
            .withColumn("kept", F.coalesce(~failed & inside, F.lit(False))))


def quality_filter(docs: DataFrame, support: int = 100) -> DataFrame:
    """The input's rows and columns without the documents that the rules reject."""
    gone = judge(docs, support).where(~F.col("kept")).select("_id", "_h").distinct()
    return whole_rows(docs).join(gone, ["_id", "_h"], "left_anti").select("_row.*")

"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import (chat_format, compact_windows, exact_dedup, fill_middle, jaccard_join, language_id,
                            line_dedup, packing, passage_quality, piece_codec, quality_rules, runlength_index,
                            source_divergence)
from clausewise.llm.common import documents


def _sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_runlength_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_index.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(documents(spark, sf_dir)).select(
        F.col("_id").alias("doc_id"), "first_id", "start_word", "n_words", "first_word")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", language_id.held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.held_out())
    scored = passage_quality.score(docs, passage_quality.fit(docs.where("not held_out"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(documents(spark, sf_dir))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir)).select(
        "lang", "source", "part", "item", "value", "rank")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: A conversation that says control strings, formatted with those of the table.
TRICKY = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    chats = chat_format.format_chat(table.unionByName(more))
    read = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                        F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["parts"], ""), F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {f.__name__: f for f in (
    op1_retrieval_packing, op2_runlength_index, op3_exact_dedup, op4_compact_windows, op5_line_dedup, op6_piece_codec, op7_passage_quality,
    op8_quality_rules, op9_jaccard_join, op10_language_id, op11_source_divergence, op12_fill_middle, op13_chat_format)}

ORACLE = {
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text""",
    "op5_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.holder <> k.doc_id, false) AS dropped
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term)
        GROUP BY w.lang, w.source, w.term),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
den AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT + 5 * any_value(v.v) AS den
        FROM grp g JOIN v USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source
        GROUP BY g.lang, g.source),
p AS (SELECT d.lang, d.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)) // d.den AS p,
             1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
      FROM den d JOIN kept k ON k.lang = d.lang JOIN v ON v.lang = d.lang
      LEFT JOIN cnt c ON c.lang = d.lang AND c.source = d.source AND c.term = k.term),
diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
         GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN diff x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_fill_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a,
             ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c,
             ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
                  WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM o""",
    "op13_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(role || chr(10) || text, '<(\\*/?s>)', '<\\\1', 'g'),
        '\[(\\*(?:/?INST|\+|(?:IMG|AUDIO|DOC):[0-9]+)\])', '[\\\1', 'g')) - 1 AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(escaped) + 17 * count(*))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}

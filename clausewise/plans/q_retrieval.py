"""Queries over embeddings and documents: dense, sparse and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.functions import probabilities as P
from clausewise.functions import text
from clausewise.operators import assess, ordering, retrieve
from clausewise.plans import inputs as I


def _docs(spark, sf):
    return ordering.spread(I.table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")


def _vectors(spark, sf):
    return I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _queries(spark, sf):
    """Benchmark passages as query texts, each with one of the label centroids."""
    c = retrieve.centroids(_vectors(spark, sf), "label")
    b = I.table(spark, sf, "benchmark")
    return b.join(c, (F.col("item_id") % 10).cast("int") == F.col("label")).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector")


def dense_topk(spark, sf):
    return retrieve.dense_topk(_queries(spark, sf), _vectors(spark, sf), 10)


def sparse_topk(spark, sf):
    return retrieve.sparse_topk(_queries(spark, sf), _docs(spark, sf), 10)


def hybrid_rrf(spark, sf):
    q = _queries(spark, sf)
    return retrieve.rrf_fuse(retrieve.dense_topk(q, _vectors(spark, sf), 10),
                             retrieve.sparse_topk(q, _docs(spark, sf), 10))


def group_dedup(spark, sf):
    chunks = _docs(spark, sf).join(_vectors(spark, sf).drop("label"), "doc_id", "left").select(
        "doc_id", "text", "embedding", F.col("source").alias("source_document_id"))
    hits = retrieve.hybrid_search(_queries(spark, sf), chunks, 10, fields=["text"])
    return retrieve.select_fields(hits, ("text", "score", "source_document_id"), ("query_id", "rank", "doc_id"))


def tfidf_vocabulary(spark, sf):
    d = _docs(spark, sf)
    s = retrieve.term_stats(retrieve.term_counts(d, "doc_id", ngram_max=2, tokens=text.model_tokens, unique=True), d.count())
    return s.withColumn("idf", F.round("idf", 6))


def tfidf_vectors(spark, sf):
    """Each document's vector: its terms, their weights added up, its squared length."""
    w = retrieve.tfidf_vectors(_docs(spark, sf), "doc_id", unique=True, min_df=2, max_df=0.95)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 6).alias("weight"),
                                   F.round(F.max("w"), 6).alias("heaviest"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("squares"))


def vector_summary(spark, sf):
    v = _vectors(spark, sf).select(
        "label", P.l2_norm("embedding").alias("norm"), P.mean_abs("embedding").alias("a"),
        P.mean_value("embedding").alias("m"))
    return v.groupBy("label").agg(
        F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.max("norm"), 6).alias("max_norm"),
        F.round(F.avg("a"), 6).alias("mean_abs"),
        F.round(P.sigmoid(F.avg("m")), 6).alias("activation_score"))


def attention_entropy(spark, sf):
    """Each vector as an attention row: squared entries over their sum."""
    v = _vectors(spark, sf)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    p = F.transform("embedding", lambda x: x.cast("double") * x.cast("double") / F.col("_t"))
    return v.withColumn("_t", total).select("doc_id", F.round(P.attention_entropy(p), 6).alias("entropy"))


def layer_rollup(spark, sf):
    from clausewise.operators.rollups import layer_activation

    return layer_activation(_layers(spark, sf))


def attention_rollup(spark, sf):
    from clausewise.operators.rollups import attention_by_head

    return attention_by_head(_layers(spark, sf))


def layer_summary(spark, sf):
    from clausewise.operators.rollups import clause_summary

    return clause_summary(_layers(spark, sf))


def _layers(spark, sf):
    """Vectors as results of a model: four layers of 16 numbers, two heads each."""
    v = _vectors(spark, sf)
    layer = lambda i: F.slice("embedding", i * 16 + 1, 16)
    return v.select(
        "doc_id", (F.col("label") + 5).alias("token_count"),
        F.concat(F.lit("label-"), "label").alias("top_label"),
        F.array(*[F.struct(F.lit(i + 1).alias("layer"), P.l2_norm(layer(i)).alias("mean_norm"),
                           F.array_max(layer(i)).cast("double").alias("max_norm"),
                           P.mean_abs(layer(i)).alias("mean_abs")) for i in range(4)])
        .alias("layer_activation"),
        F.array(*[F.struct(F.lit(i + 1).alias("layer"), F.lit(h).alias("head"),
                           P.mean_value(F.slice("embedding", i * 16 + h * 8 + 1, 8)).alias("mean"),
                           F.array_max(F.slice("embedding", i * 16 + h * 8 + 1, 8)).cast("double").alias("max"),
                           P.mean_abs(F.slice("embedding", i * 16 + h * 8 + 1, 8)).alias("entropy"))
                  for i in range(4) for h in range(2)]).alias("attention"))


#: What a claim's search asks for, and what it may be judged on.
HITS = 18


def retrieve_with_fallback(spark, sf):
    """Vector hits for clauses of documents that have a vector; lexical for the rest.

    A clause is searched by its document's vector among all controls, each of which has the
    mean vector of a label.
    """
    docs = I.policy_docs(spark, sf)
    extra = I.ground_truth_controls(spark, sf)
    controls = assess.prepare_controls(extra).select("seq", "regulation", "control_id", "title", "requirement")
    vectors = _vectors(spark, sf)
    placed = controls.join(retrieve.centroids(vectors, "label"), (F.col("seq") % 10).cast("int") == F.col("label")).select(
        F.col("seq").cast("bigint").alias("seq"), "query_vector")
    asked = vectors.where("embedding is not null").select(
        F.col("doc_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    near = retrieve.dense_topk(asked, placed, HITS, key="seq", vector="query_vector")
    hits = near.where(F.col("rank") <= HITS).select(F.col("query_id").alias("doc_id"), "seq")
    out = assess.retrieve_with_fallback(assess.claims(docs), hits, extra, limit=HITS, collection=controls)
    v = assess.verdict_rows(assess.with_verdicts(out))
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation", "control_id",
                    "score", "source", "compliant")


QUERIES = {f.__name__: f for f in (
    dense_topk, sparse_topk, hybrid_rrf, group_dedup, tfidf_vocabulary, tfidf_vectors, vector_summary,
    attention_entropy, layer_rollup, attention_rollup, layer_summary, retrieve_with_fallback)}

# --- SQL ----------------------------------------------------------------------------

_DENSE = """cent AS (SELECT label, list(m ORDER BY d) AS v FROM (
  SELECT label, d, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
  GROUP BY label, d) GROUP BY label),
q AS (SELECT item_id AS query_id, text AS query_text, v FROM benchmark JOIN cent ON item_id % 10 = label),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM q, embeddings)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 200)"""
_SPARSE = """dtf AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY ALL),
stats AS (SELECT *, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS cf FROM dtf GROUP BY term)),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM dtf JOIN stats USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id),
qtf AS (SELECT query_id, term, count(*) AS tf FROM (
  SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]{2,}')) AS term FROM q) GROUP BY ALL),
qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN stats USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(dw.w * qw.w) / min(dn.n) / min(qn.n), 6) AS score
    FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 200)"""
_FUSED = """fused AS (SELECT query_id, doc_id, round(coalesce(0.7::DOUBLE / (60 + d.rank), 0) + coalesce(0.3::DOUBLE / (60 + s.rank), 0), 9) AS score
  FROM dense d FULL JOIN sparse s USING (query_id, doc_id))"""
# Letters and digits beyond ASCII become "_": no part of a term, but no bound of a word either.
_MODEL_TERMS = """t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[^\\P{L}a-z]|[^\\P{N}0-9]', '_', 'g'),
  '\\b[a-z0-9][a-z0-9'']+\\b') AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t),
c AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)"""
_NORM = "sqrt(list_sum(list_transform({x}, lambda v: v::DOUBLE * v::DOUBLE)))"
_ABS = "(list_sum(list_transform({x}, lambda v: abs(v::DOUBLE))) / len({x}))"
_MEAN = "(list_sum(list_transform({x}, lambda v: v::DOUBLE)) / len({x}))"
_LAYERS = "layers AS (SELECT label, i + 1 AS layer, embedding[i * 16 + 1 : i * 16 + 16] AS x FROM embeddings, range(4) r(i))"

from clausewise.plans import q_assess as A  # noqa: E402

ORACLE = {
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dense",
    "sparse_topk": f"WITH {_DENSE}, {_SPARSE} SELECT * FROM sparse",
    "hybrid_rrf": f"WITH {_DENSE}, {_SPARSE}, {_FUSED} SELECT * FROM fused",
    "group_dedup": f"""WITH {_DENSE}, {_SPARSE}, {_FUSED}, g AS (SELECT f.*, source AS source_document_id, text
  FROM fused f JOIN documents USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) = 1)
SELECT query_id, row_number() OVER w AS rank, doc_id, text, score, source_document_id FROM g
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "tfidf_vocabulary": f"""WITH {_MODEL_TERMS}
SELECT *, round(ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term)""",
    "tfidf_vectors": f"""WITH {_MODEL_TERMS}, s AS MATERIALIZED (SELECT term, df, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df FROM c GROUP BY term), (SELECT count(*) AS n FROM documents) WHERE df >= 2 AND df <= 0.95 * n),
w AS (SELECT doc_id, (1 + ln(tf)) * idf AS w FROM c JOIN s USING (term)),
u AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS weight, round(max(w), 6) AS heaviest, round(sum(w * w), 6) AS squares FROM u GROUP BY doc_id""",
    "vector_summary": f"""SELECT label, round(avg({_NORM.format(x='embedding')}), 6) AS mean_norm,
  round(max({_NORM.format(x='embedding')}), 6) AS max_norm, round(avg({_ABS.format(x='embedding')}), 6) AS mean_abs,
  round(1 / (1 + exp(-avg({_MEAN.format(x='embedding')}))), 6) AS activation_score FROM embeddings GROUP BY label""",
    "attention_entropy": """WITH s AS (SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT doc_id, x * x / sum(x * x) OVER (PARTITION BY doc_id) AS p FROM s)
SELECT doc_id, round(-sum(p * ln(p + 1e-12::DOUBLE)), 6) AS entropy FROM p GROUP BY doc_id""",
    "layer_rollup": f"""WITH {_LAYERS} SELECT layer::INT AS layer, round(avg({_NORM.format(x='x')}), 6) AS mean_norm,
  round(avg(list_max(x)::DOUBLE), 6) AS max_norm, round(avg({_ABS.format(x='x')}), 6) AS mean_abs FROM layers GROUP BY layer""",
    "attention_rollup": f"""WITH {_LAYERS}, h AS (SELECT layer, head, x[head * 8 + 1 : head * 8 + 8] AS y FROM layers, range(2) r(head))
SELECT layer::INT AS layer, head::INT AS head, round(avg({_MEAN.format(x='y')}), 6) AS mean,
  round(avg(list_max(y)::DOUBLE), 6) AS max, round(avg({_ABS.format(x='y')}), 6) AS entropy FROM h GROUP BY layer, head""",
    "layer_summary": """SELECT 'label-' || label AS top_label, count(*) AS clauses,
  round(avg(label + 5), 6) AS avg_token_count FROM embeddings GROUP BY label""",
    "retrieve_with_fallback": f"""{A._DOCS}, {A.VERDICTS.replace('__REG__', 'true').replace('verdicts AS (', 'lex AS (')}, {_DENSE},
placed AS (SELECT g.*, v FROM ground g JOIN cent ON g.k % 10 = label),
near AS (SELECT vec_id AS doc_id, k FROM embeddings, placed WHERE embedding IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, k) <= 18),
vhits AS (
  SELECT c.doc_id, clause_index, clause, check_seq, check_id, matched, tokens, regulation, g.control_id, title, requirement,
    coalesce(signals, []) AS signals,
    len(list_filter(matched, lambda k: contains(lower(requirement), k))) AS overlap,
    len(list_intersect(tokens, list_distinct(regexp_extract_all(lower(g.control_id || ' ' || title || ' ' || requirement), '[a-z0-9]{{3,}}')))) AS shared
  FROM claims c JOIN near n ON n.doc_id = c.doc_id JOIN ground g ON g.k = n.k
  LEFT JOIN signals s ON s.control_id = g.control_id),
vcap AS (SELECT * FROM vhits WHERE shared + 2 * overlap > 0 QUALIFY row_number() OVER (
  PARTITION BY doc_id, clause_index, check_id, regulation ORDER BY shared + 2 * overlap DESC, control_id DESC) <= 5),
vec AS (SELECT *, shared + 2 * overlap AS score, 'vector' AS source,
  overlap >= 2 OR (overlap >= 1 AND len(list_filter(signals, lambda s: contains(lower(clause), s))) > 0) AS compliant,
  row_number() OVER (PARTITION BY doc_id, clause_index, check_id ORDER BY shared + 2 * overlap DESC, regulation DESC, control_id DESC) AS rank
  FROM vcap)
SELECT doc_id, clause_index, check_id, rank, regulation, control_id, score::DOUBLE AS score, source, compliant FROM vec
UNION ALL SELECT doc_id, clause_index, check_id, rank, regulation, control_id, score::DOUBLE, source, compliant FROM lex
WHERE (doc_id, clause_index, check_id) NOT IN (SELECT (doc_id, clause_index, check_id) FROM vec)""",
}

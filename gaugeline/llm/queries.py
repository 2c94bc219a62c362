"""The registered queries of the operators: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import decontam, metric_join, mixing, ngram_join, packing, periods, quality, sharding, substrings, surrogates, token_counts, toxicity, vector_codes
from gaugeline.llm.common import one_in, table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return register


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def op1_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedupe(table(spark, folder, "documents"))


def grades(labels: DataFrame) -> DataFrame:
    """The ratings of ``labels`` as grades: 0 low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


@query()
def op2_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, grades(table(spark, folder, "labels")), levels=3))


#: A stand-in for the secret that a real run takes from its own store.
SURROGATE_KEY = "set-your-own"


@query()
def op3_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query()
def op4_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score(table(spark, folder, "documents"))


EMBEDDING_SQL = """
WITH fine AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a) SELECT a, min(b) AS b FROM walk GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(r.b, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(r.b, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id LEFT JOIN reach r ON r.a = v.vec_id
"""


@query(EMBEDDING_SQL)
def op5_pivot_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.join(table(spark, folder, "embeddings"))


@query()
def op6_noisy_or_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", one_in(F.col("doc_id"), 5).alias("held_out"), "score", "predicted", "worst_sentence", "offending")


@query()
def op7_fm_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontam.digest(decontam.mark(docs, table(spark, folder, "benchmark")))


@query()
def op8_skip_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


@query()
def op9_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


@query()
def op10_grouped_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizer())


@query()
def op11_block_convolution(spark: SparkSession, folder: str) -> DataFrame:
    return periods.find(table(spark, folder, "documents"), plant=True)


def code_sql(rounds: int = 4) -> str:
    """The codes in plain SQL: all distances of every part to every entry, round by round."""
    square = "list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])"
    nearest = """a{k} AS MATERIALIZED (
    SELECT vec_id, label, p.p, arg_min(e, [d, e]) AS e, min(d) AS d, any_value(x) AS x
    FROM (SELECT p.*, b.e, {xx} + {bb} - 2 * list_inner_product(p.x::DOUBLE[], b.x::DOUBLE[]) AS d FROM parts p JOIN b{k} b ON b.p = p.p) p
    GROUP BY vec_id, label, p.p
)""".replace("{xx}", square.format("p.x")).replace("{bb}", square.format("b.x"))
    refined = """, b{n} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
        SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS x
        FROM (SELECT p, e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(i) GROUP BY p, e, i) GROUP BY p, e
    ) m ON m.p = b.p AND m.e = b.e
), """
    sql = """
WITH fine AS (
    SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS nth
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, nth, p::INT AS p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM fine, range(4) t(p)
), b0 AS MATERIALIZED (SELECT p, nth AS e, x FROM parts WHERE nth < 256), """
    for k in range(rounds):
        sql += nearest.replace("{k}", str(k)) + refined.replace("{k}", str(k)).replace("{n}", str(k + 1))
    sql += nearest.replace("{k}", str(rounds)) + """, told AS (
    SELECT vec_id, label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{k} GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v, ',' ORDER BY p, e)) FROM (SELECT p, e, array_to_string(x, ',') AS v FROM b{k})) AS codebooks_sha256
FROM told""".replace("{k}", str(rounds))
    return sql


@query(code_sql())
def op12_grid_cell_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(table(spark, folder, "embeddings"))


@query()
def op13_spliced_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count(table(spark, folder, "documents"), public_tokenizer("piece_bpe_32k.model"))

"""The queries opN_<name> over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import jaccard_groups
from .lines import MARK, removed_line_lists
from .media import store_texts
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .scratch import Scratch
from .segment import sample_segmentations
from .sharding import shard_records
from .topk import top_k, whole_components
from .toxicity import fit_toxicity, score_toxicity
from .urls import judge_urls, link_edges, parse_rule

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
SHARDS = 24
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
TOXIC_FROM, GOOD_FROM = 0.5, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), words=3, num=9, den=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op2")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()), scratch)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), vocabulary(PIECES), k=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()), Scratch(spark, "op5"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), vocabulary(TOKENIZER))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"), "mulaw")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_components(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 50 == 0, Scratch(spark, "op8"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), Scratch(spark, "op9"), [parse_rule(*r) for r in RULES], link_edges(pages))
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lines.alias("n_lines"))
    marked = removed_line_lists(docs, Scratch(spark, "op10"), min_words=1)
    gone = F.coalesce(F.col(MARK), F.array().cast("array<int>"))
    return marked.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_toxicity, op3_sharding, op4_sampled_segmentation, op5_quality, op6_packing, op7_telephony_audio, op8_top_k, op9_url_filter, op10_line_dedup]
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    jaccard = f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON t.a = r.c)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
        FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
    best = """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM k WHERE r <= 5"""
    rules = ", ".join(f"('{verdict}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{text}')" for verdict, text in RULES)
    urls = f"""
        WITH p AS (
            SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(verdict, host, path, rule) AS (VALUES {rules}),
        m AS (SELECT page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""
    return {"op1_ngram_jaccard_join": jaccard, "op8_top_k": best, "op9_url_filter": urls}

"""The numbered corpus queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, jaccard_join, language, pieces, quality, suffix_dedup, topk, toxicity, url_filter
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 32k BPE model."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.get("ends", F.size("ends") - 1).cast("long").alias("n_bytes"),
    )


URL_RULES = [
    url_filter.host_rule("com", "/", "allow"),
    url_filter.host_rule("example.com", "/en/", "block"),
    url_filter.host_rule("www.example.com", "/en/", "allow"),
    url_filter.host_rule("net", "/es/", "block"),
    url_filter.host_rule("net", "/fr/", "block"),
]

OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
rules(host_part, path_part, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(host_part || path_part) DESC NULLS LAST) AS rn
  FROM (SELECT *, row_number() OVER () AS rid FROM p)
  LEFT JOIN rules ON (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part))
SELECT page_id, host, path, host_part || path_part AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""


@query("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the allow and block rules; urls that no rule fits are allowed."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS rid FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS bs FROM benchmark),
bl AS (SELECT item, bs, least(len(bs), 10) AS wl FROM b WHERE len(bs) > 0),
bw AS (SELECT DISTINCT item, wl, array_to_string(bs[i : i + wl - 1], ' ') AS win FROM (SELECT item, bs, wl, unnest(range(1, len(bs) - wl + 2)) AS i FROM bl)),
dw AS (SELECT rid, wl, i, array_to_string(ws[i : i + wl - 1], ' ') AS win FROM (
  SELECT rid, ws, wl, unnest(range(1, len(ws) - wl + 2)) AS i FROM w, (SELECT DISTINCT wl FROM bl))),
m AS (SELECT rid, dw.wl, i, item FROM dw JOIN bw USING (wl, win)),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + wl)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""


@query("op8_decontaminate", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the benchmark's ten-word windows in all documents."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)
"""


@query("op5_jaccard_join", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard similarity of 0.75 or more over five-word shingles."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove all bytes in 100-byte strings that start earlier in the corpus."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; documents with fold 2 of 4 are held out of the training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = language.train(docs.filter("not held_out").select("text", "lang"))
    found = docs.select("doc_id", "held_out", "text").withColumn("found", language.identify(docs, model))
    shares = F.transform("found.languages", lambda x: F.concat_ws(":", x["lang"], F.format_number(x["share"], 3)))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.concat_ws(" ", shares).alias("mixture"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's toxicity; rows with fold 0 of 5 are held out of the training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = toxicity.train(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    found = docs.withColumn("found", toxicity.score(docs, model))
    scored = found.select("doc_id", "held_out", F.col("found.score").alias("score"), F.col("found.voters").alias("n_voters"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_voters")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op7_topk", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the container paths that its host's pages agree on."""
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep documents whose perplexity under trusted text is within their language's quantile."""
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.round(F.exp("logppl"), 6).alias("perplexity"), F.round(F.exp("most"), 6).alias("threshold"), "keep")

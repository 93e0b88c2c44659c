"""The operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import bpe, decontaminate, html_text, lines, minhash, mixing, negatives, neighbours, passages, quality, repeats, shards, whitening
from farelens.llm.common import documents

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("byte_bpe_50k.json")))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(documents(spark, sf_dir))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(documents(spark, sf_dir).select("doc_id"), SHARDS)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    cleaned = lines.drop_boilerplate(docs)
    return cleaned.select(
        "doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    # The operator's deviation is an exact decimal; one beyond long would be NULL here.
    return whitening.whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return negatives.mine(vectors)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.find_contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_mix": op1_mix,
        "op2_neighbours": op2_neighbours,
        "op3_html": op3_html,
        "op4_passages": op4_passages,
        "op5_quality": op5_quality,
        "op6_repeats": op6_repeats,
        "op7_bpe": op7_bpe,
        "op8_minhash": op8_minhash,
        "op9_shard": op9_shard,
        "op10_lines": op10_lines,
        "op11_whiten": op11_whiten,
        "op12_negatives": op12_negatives,
        "op13_decontaminate": op13_decontaminate,
        "pipeline": pipeline,
    }


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM r),
f AS (SELECT *, 3 * ssize / CAST(wt AS DOUBLE) AS full_at FROM w),
g AS (SELECT *, CAST(sum(ssize) OVER () AS DOUBLE) AS budget,
        coalesce(sum(3 * ssize) OVER (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
      FROM f),
l AS (SELECT *, (budget - CAST(full_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS lvl FROM g),
m AS (SELECT *, coalesce(max(CASE WHEN lvl <= full_at THEN lvl END) OVER (), max(full_at) OVER ()) AS water FROM l),
t AS (SELECT source, ssize, rnk, CASE WHEN full_at <= water THEN CAST(3 * ssize AS DOUBLE) ELSE wt * water END AS target FROM m),
q AS (SELECT d.*, t.ssize, t.rnk, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e.e, CAST(e.e * ssize + place AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) e(e) WHERE size > 0),
u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rnk, k, doc_id, e ROWS UNBOUNDED PRECEDING) AS up_to FROM c),
x AS (SELECT doc_id, sum(size) AS taken FROM u WHERE up_to <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.ssize AS source_size, q.target,
       CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN x USING (doc_id)
"""

ORACLE_OP10 = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT doc_id, source, text, line, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT source, key, count(DISTINCT doc_id) AS pages FROM k WHERE key <> '' GROUP BY source, key),
h AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT n.source, n.key FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source
      WHERE n.pages >= 3 AND n.pages > CAST(0.1 AS DOUBLE) * h.total)
SELECT k.doc_id, k.source,
       count(*) FILTER (WHERE k.key <> '') AS n_lines,
       count(*) FILTER (WHERE b.key IS NOT NULL) AS n_dropped,
       CASE WHEN any_value(k.text) IS NOT NULL
            THEN sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE b.key IS NULL), '')) END AS text_sha256
FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key
GROUP BY k.doc_id, k.source
"""

ORACLE_OP13 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM bi),
di AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) lengths WHERE len(w) >= m),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM di),
h AS (SELECT dw.r, dw.m, dw.i, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS place FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN n ON d.r = n.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": ORACLE_OP1, "op10_lines": ORACLE_OP10, "op13_decontaminate": ORACLE_OP13}

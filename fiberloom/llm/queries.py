"""The queries that apply the corpus operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberloom.llm import ann, bpe, html_text, jaccard, langid, linededup, mixing, oracles, quality, quotes, secrets, timeparts, warc, whitening
from fiberloom.llm.common import table
from fiberloom.runtime import scratch


def tokenizer_path() -> str:
    """Place of the public byte-level tokenizer, which is never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The pages table has no archive around it. Every page becomes a response and a later (at times an
#: earlier) revisit with its own validators, over all pages; both engines run this text.
CAPTURES = """
SELECT concat('r', CAST(page_id AS STRING)) AS record_id, url, 'response' AS kind, 200 AS status, page_id * 600 AS seconds,
  md5(html) AS etag, NULL AS cache_control, CAST(length(html) AS STRING) AS content_length, md5(html) AS digest FROM pages
UNION ALL
SELECT concat('v', CAST(page_id AS STRING)) AS record_id, concat(replace(url, 'http', 'HTTP'), '#again') AS url, 'revisit' AS kind, 304 AS status,
  page_id * 600 + CASE WHEN page_id % 11 = 3 THEN -60 ELSE (page_id % 5) * 86400 + 300 END AS seconds,
  CASE WHEN page_id % 10 = 7 THEN 'stale' WHEN page_id % 10 = 8 THEN NULL ELSE concat('W/', md5(html)) END AS etag,
  concat('max-age=', CAST(page_id % 1000 AS STRING)) AS cache_control, '0' AS content_length, md5(html) AS digest FROM pages
"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    header = lambda name, c: F.struct(F.lit(name).alias("k"), F.col(c).alias("v"))
    pairs = F.array(header("ETag", "etag"), header("Cache-Control", "cache_control"), header("Content-Length", "content_length"))
    held = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
    return rows.select("record_id", "url", F.timestamp_seconds("seconds").alias("ts"), "kind", "status", held.alias("headers"), "digest")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(spark, sf_dir))
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return out.select("record_id", "url", F.unix_seconds("ts").alias("seconds"), "status", "response_id", F.unix_seconds("response_ts").alias("response_seconds"), "body_digest", header("etag"), header("cache-control"), header("content-length"))


#: The conversations hold no quotation marks. Every turn but the first is given the quotation of an
#: earlier one, and of what that one may quote, over all conversations; both engines run this text.
MAIL = """
SELECT conv_id, turn, role, concat(
  CASE WHEN q IS NULL THEN '' ELSE concat('> ', replace(q, '\n', '\n> '), '\n') END,
  CASE WHEN p IS NULL THEN '' ELSE concat('>> ', p, '\n') END, text) AS text, text AS own, q, quoted FROM (
  SELECT *, CASE WHEN turn % 3 = 2 THEN p3 ELSE p1 END AS q, CASE WHEN turn % 3 = 2 THEN t3 ELSE t1 END AS quoted, CASE WHEN turn % 3 = 0 THEN split_part(p3, '\n', 1) END AS p FROM (
    SELECT conv_id, turn, role, text, lag(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS p1, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS p3,
      lag(turn, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS t1, lag(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS t3 FROM conversations))
"""


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = spark.sql(MAIL.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))
    out = quotes.link(mail.select("conv_id", "turn", "role", "text"))
    return out.select(F.col("thread").alias("conv_id"), F.col("pos").alias("turn"), F.col("author").alias("role"), F.col("parent").alias("parent_turn"), "depth", F.col("root").alias("root_turn"), "n_passages", "n_linked", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    asked = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(asked, model, keep=["doc_id", "held_out"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, words=secrets.learn(docs)).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(vectors, whitening.fit(vectors))
    each = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


#: When a click counts: k tells old ones and those of which only the week is known.
MOMENT = """
CASE WHEN pmod(crc32(CAST(click_id AS STRING)), 128) < 16 THEN ts - make_dt_interval(CAST(power(pmod(crc32(CAST(click_id AS STRING)), 128) + 6, 3) AS INT))
  WHEN pmod(crc32(CAST(click_id AS STRING)), 128) > 111 THEN CAST(date_sub(CAST(ts AS DATE), weekday(CAST(ts AS DATE))) AS TIMESTAMP_NTZ) ELSE ts END
"""
PARTS = 800


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // PARTS
    parts = timeparts.TimeParts(scratch(spark), clicks, F.expr(MOMENT), ["arrived_at", "click_id"], limit)
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-04-01").cast("timestamp_ntz"), F.lit(False))
    starting = parts.write(early)
    parts.rewrite(starting)
    return parts.report(starting, "click_id", ~early)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_revisits": op1_revisits,
    "op4_quotations": op4_quotations,
    "op7_nearest": op7_nearest,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality": op6_quality,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_time_partitions": op12_time_partitions,
    "op13_line_dedup": op13_line_dedup,
}

#: SQL can't express the others: they hash, train, tokenize, parse HTML or search by score.
ORACLE_SQL: dict[str, str] = {"op1_revisits": oracles.revisits(CAPTURES), "op4_quotations": oracles.quotations(MAIL)}

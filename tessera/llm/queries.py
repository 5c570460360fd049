"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, mixing, pii, quality_pu, quality_rules, simhash, toxicity, vectors, warc


#: Rows of an Arrow batch: the operators work on slices of some hundred texts, so larger batches only take memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches are held to BATCH rows."""
    if not 0 < int(spark.conf.get(BATCH[0], "10000")) <= BATCH[1]:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.fit(docs, read(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    v = bpe.Vocabulary.load(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), v)
    return out.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    back = chat.read_back(chat.windows(turns.unionAll(own)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), max_repeats=4.0).select("doc_id", "source", "epoch", "place")


def op7_embedding_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = warc.write_arc(read(spark, sf_dir, "pages"))
    records = warc.read_warc(spark, warc.convert(spark, arc))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", warc.page_in("refers_to").alias("refers_to"))


def op9_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.settled(docs, key or pii.session_key(spark), "p").select("doc_id", "p.text", F.size("p.kinds").alias("n_entities"), F.array_sort("p.kinds").alias("kinds"), "p.surrogates")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_vptree, op2_quality_pu, op3_quality_rules, op4_bpe, op5_chat_windows, op6_temperature_mixing, op7_embedding_cross_polytope, op8_warc_from_arc, op9_toxicity_kernel, op10_pii_surrogates)}


OP5_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS pos, (ceil(length(text) / 4) + 4)::bigint AS size,
    length(regexp_replace(role, '[<\\[\\]\\\\]', '..', 'g')) + length(regexp_replace(text, '[<\\[\\]\\\\]', '..', 'g')) + {len(chat.TURN + chat.MID + chat.END)} AS len
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, md5(text))
), s AS (
  SELECT *, max(CASE WHEN pos = 1 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id) AS system,
    CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE size END AS own FROM n
), g(conv_id, pos, used, w) AS (
  SELECT conv_id, pos, own, pos FROM s WHERE (pos - 1) % {chat.PART} = 0
  UNION ALL SELECT s.conv_id, s.pos,
    CASE WHEN g.used > 0 AND g.used + s.own > {chat.BUDGET} - coalesce(s.system, 0) - CASE WHEN g.w = 1 THEN 0 ELSE {chat.BUDGET // 4} END THEN s.own ELSE g.used + s.own END,
    CASE WHEN g.used > 0 AND g.used + s.own > {chat.BUDGET} - coalesce(s.system, 0) - CASE WHEN g.w = 1 THEN 0 ELSE {chat.BUDGET // 4} END THEN s.pos ELSE g.w END
  FROM g JOIN s ON s.conv_id = g.conv_id AND s.pos = g.pos + 1 AND (s.pos - 1) % {chat.PART} > 0
), l AS (
  SELECT g.conv_id, g.w, least({chat.BUDGET // 4}, {chat.BUDGET} - coalesce(max(s.system), 0) - sum(s.own)) AS room, max(s.system) AS system
  FROM g JOIN s ON s.conv_id = g.conv_id AND s.pos = g.pos WHERE g.w > 1 GROUP BY ALL
), h AS (
  SELECT l.conv_id, s.len, l.room, sum(s.size) OVER (PARTITION BY l.conv_id, l.w ORDER BY s.pos DESC) AS back
  FROM l JOIN s ON s.conv_id = l.conv_id AND s.pos BETWEEN l.w - {chat.HISTORY} AND l.w - 1 AND NOT (s.pos = 1 AND l.system IS NOT NULL)
), r AS (
  SELECT conv_id, sum(len) AS again FROM (
    SELECT conv_id, len FROM h WHERE back <= room
    UNION ALL SELECT l.conv_id, s.len FROM l JOIN s ON s.conv_id = l.conv_id AND s.pos = 1 AND l.system IS NOT NULL)
  GROUP BY ALL
)
SELECT s.conv_id, count(*) AS n_turns,
  sha256(string_agg(s.role || chr(10) || s.text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(s.text)) FILTER (s.role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(s.text, '' ORDER BY pos) FILTER (s.role = 'assistant'), '')) AS loss_sha256,
  (sum(s.len) + coalesce(max(r.again), 0))::bigint AS formatted_chars
FROM s LEFT JOIN r ON r.conv_id = s.conv_id GROUP BY s.conv_id
"""

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, greatest(1, ceil(length(coalesce(text, '')) / 4))::bigint AS tk,
    md5('{mixing.SEED}|' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) AS key FROM documents
), s AS (SELECT source, sum(tk)::bigint AS t, count(*) AS n, (sum(tk) / sum(sum(tk)) OVER ())::double AS p FROM d GROUP BY source
), a AS (SELECT CASE WHEN max(p) = min(p) THEN 0 ELSE greatest(0, least(1, 1 - ln(4.0) / ln(max(p) / min(p)))) END AS alpha FROM s
), w AS (SELECT s.*, exp(alpha * ln(p)) / sum(exp(alpha * ln(p))) OVER () AS w FROM s, a
), b AS (SELECT *, round(w * max(t / w) OVER ())::bigint AS budget FROM w
), f AS (SELECT source, t, budget // t AS laps, budget % t AS rest, ceil(n / {mixing.BLOCK})::bigint AS blocks FROM b
), x AS (
  SELECT d.*, f.laps, f.rest, ('0x' || substr(d.key, 1, 15))::bigint % f.blocks AS block, md5(d.key || '|' || f.laps) AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), y AS (SELECT *, md5('{mixing.SEED}|' || laps || '|' || block) AS place FROM x
), z AS (SELECT *, sum(tk) OVER (PARTITION BY source ORDER BY place, block, own) - tk AS upto FROM y
), e AS (SELECT doc_id, source, key, block, unnest(range(1, laps + CASE WHEN upto < rest THEN 1 ELSE 0 END + 1))::bigint AS epoch FROM z)
SELECT doc_id, source, epoch, md5('{mixing.SEED}|' || (epoch - 1) || '|' || block) || md5(key || '|' || (epoch - 1)) AS place FROM e
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::bigint, 5))::bigint) AS parts FROM d)
SELECT page_id, n::bigint AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (parts[1 + i // 4] >> (15 - 5 * (i % 4))) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_windows": OP5_SQL, "op6_temperature_mixing": OP6_SQL, "op8_warc_from_arc": OP8_SQL}

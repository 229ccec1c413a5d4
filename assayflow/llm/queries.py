"""The queries that apply the corpus operators to their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clusters, decontaminate, exact_dedup, packing, quality, ring, secrets, simhash, suffix_dedup, toxicity, warc, whitening
from .common import materialize, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = materialize(secrets.dictionary(docs), "dictionary")
    return secrets.scan(docs, secrets.fit(secrets.labelled_findings(spark), words), words=words)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{escaped}'), (-7L, 1L, 'assistant', '{escaped}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_chats(rows)
    turns = chat_format.read_turns(F.col("formatted"))
    learnt = chat_format.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    text = out.withColumn("turns", turns).withColumn("learnt", learnt)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return text.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    line = lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    return found.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), line)), "|"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True).drop("spans", "chars")


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ring.shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_quality_classifier, op3_best_fit_packing, op4_toxicity, op5_secret_scan, op6_simhash_near_dedup,
        op7_chat_format, op8_suffix_array_dedup, op9_warc_revisits, op10_benchmark_decontamination, op11_ring_shards,
        op12_embedding_whitening, op13_centroid_clusters,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

_CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role=", "<|/role|>"]
_TAMED = " + ".join(f"2 * ((length(text) - length(replace(text, '{c}', ''))) // {len(c)})" for c in _CONTROLS)

#: Walks the turns with the role before each, by the same moves.
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior,
         length(text) + (length(text) - length(replace(text, '~', ''))) + {_TAMED}
         + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE NULL END AS chars
  FROM t
), o AS (
  SELECT *, NOT (CASE WHEN pos = 0 THEN role IN ('system', 'user')
                      WHEN role = 'user' THEN prior IN ('system', 'assistant')
                      WHEN role = 'assistant' THEN prior = 'user' ELSE false END) AS bad FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       NOT bool_or(bad) AND arg_max(role, pos) = 'assistant' AS valid,
       CASE WHEN bool_or(bad) THEN min(pos) FILTER (bad) WHEN arg_max(role, pos) <> 'assistant' THEN max(pos) END AS first_bad_turn
FROM o GROUP BY conv_id
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
n AS (SELECT item_id, least(13, len(w)) AS size, unnest([array_to_string(w[k : k + least(13, len(w)) - 1], ' ') FOR k IN range(1, greatest(1, len(w) - 12) + 1)]) AS win
      FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM n),
p AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d CROSS JOIN sizes WHERE len(w) >= size),
h AS (SELECT p.doc_id, p.pos, p.size, n.item_id FROM (SELECT doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS win FROM p) p JOIN n ON p.size = n.size AND p.win = n.win),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""

#: CRC-32 byte by byte; 3988292384 is its reversed polynomial, a fixed value.
_CRC_TABLE = "SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)"
_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, v: xor(c // 256, t[CAST(xor(c % 256, v) AS INT) + 1]), 4294967295), 4294967295)"

#: Rounds as recursion: each carries all segments, placed and not, and sends the latter to the next shard with room.
OP11_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}), t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS point, strlen(text) + 1 AS size, {_CRC} AS text_crc32 FROM t CROSS JOIN crc
), nodes AS (
  SELECT shard, CAST('0x' || left(p, 4) AS INT) // 4 AS spot, min(p) AS point
  FROM (SELECT s AS shard, md5('shard#' || s || '#' || v) AS p FROM range(16) a(s), range(128) b(v)) GROUP BY ALL
), walk AS (SELECT *, coalesce(lag(spot) OVER w, max(spot) OVER (PARTITION BY shard) - 16384) AS prior FROM nodes WINDOW w AS (PARTITION BY shard ORDER BY spot)),
met AS (SELECT shard, point, spot, unnest(range(prior + 1, spot + 1)) AS seen FROM walk),
ring AS (SELECT (seen + 16384) % 16384 AS cell, list(shard ORDER BY spot - seen, point) AS prefers FROM met GROUP BY 1),
rows AS (SELECT *, CAST('0x' || left(point, 4) AS INT) // 4 AS cell FROM d),
counts AS (SELECT cell, count(*) AS n FROM rows GROUP BY 1),
quotas AS (SELECT s AS shard, (SELECT count(*) FROM d) // 16 + CASE WHEN s < (SELECT count(*) FROM d) % 16 THEN 1 ELSE 0 END AS quota FROM range(16) a(s)),
segments AS (
  SELECT 0 AS round, cell, CAST(0 AS BIGINT) AS low, n AS high, CAST(NULL AS BIGINT) AS shard, CAST(NULL AS BIGINT) AS start FROM counts
  UNION ALL
  SELECT round + 1, cell, p.low, p.high, p.shard, p.start FROM (
    WITH used AS (SELECT q.shard, any_value(quota) AS quota, coalesce(sum(g.high - g.low), 0) AS n FROM quotas q LEFT JOIN segments g ON g.shard = q.shard GROUP BY 1),
    spare AS (SELECT list(shard) AS ok FROM used WHERE n < quota),
    asking AS (SELECT g.round, g.cell, g.low, g.high, list_filter(prefers, lambda s: list_contains(ok, s))[1] AS target FROM segments g JOIN ring USING (cell) CROSS JOIN spare WHERE g.shard IS NULL),
    begun AS (SELECT a.*, quota, n + coalesce(sum(high - low) OVER (PARTITION BY target ORDER BY cell, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM asking a JOIN used u ON u.shard = a.target),
    cut AS (SELECT *, low + greatest(0, least(high - low, quota - begin_at)) AS mid FROM begun)
    SELECT round, cell, struct_pack(low := CAST(low AS BIGINT), high := CAST(mid AS BIGINT), shard := CAST(target AS BIGINT), start := CAST(begin_at AS BIGINT)) AS p FROM cut WHERE mid > low
    UNION ALL SELECT round, cell, struct_pack(low := CAST(mid AS BIGINT), high := CAST(high AS BIGINT), shard := CAST(NULL AS BIGINT), start := CAST(NULL AS BIGINT)) FROM cut WHERE high > mid
    UNION ALL SELECT round, cell, struct_pack(low := low, high := high, shard := shard, start := start) FROM segments WHERE shard IS NOT NULL AND EXISTS (FROM segments WHERE shard IS NULL)
  )
), final AS (SELECT * FROM segments WHERE round = (SELECT max(round) FROM segments)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY point, doc_id) - 1 AS rank FROM rows)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(f.shard AS INT) AS shard, f.start + rank - f.low AS slot, CAST(NULL AS INT) AS grown_shard
FROM ranked r JOIN final f ON f.cell = r.cell AND r.rank >= f.low AND r.rank < f.high
"""

#: Every assignment and every replacement of the ten rounds in turn.
_NEAREST = "a{r} AS MATERIALIZED (SELECT i, min(struct_pack(d := d, c := c)) AS best FROM (SELECT i, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{r} m USING (k) GROUP BY ALL) GROUP BY i)"
_MOVED = """m{s} AS MATERIALIZED (SELECT m.c, m.k, CASE WHEN n IS NULL THEN m.x ELSE (t - ((t % n) + n) % n) // n END AS x
  FROM m{r} m LEFT JOIN (SELECT best.c AS c, k, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{r} JOIN v USING (i) GROUP BY ALL) USING (c, k))"""
OP13_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT i, unnest(range(64)) AS k, unnest(x) AS x FROM e),
m0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS k, unnest(x) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM e ORDER BY c LIMIT 8)),
""" + ",\n".join(_NEAREST.format(r=r) + (",\n" + _MOVED.format(r=r, s=r + 1) if r < 10 else "") for r in range(11)) + """,
h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY k)) AS centroid_sha256 FROM m10 GROUP BY 1)
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN e USING (i) JOIN h ON h.c = best.c
"""


OP9_SQL = r"""
WITH b AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size, page_id // 3 AS t FROM pages),
r AS (
  SELECT 2 * page_id AS record_id, url, t AS captured, 'response' AS type, '"' || digest[1:16] || '"' AS etag, digest,
         'content-length:' || size || '|content-type:text/html|date:' || t || '|etag:"' || digest[1:16] || '"' AS headers, size FROM b
  UNION ALL
  SELECT 2 * page_id + 1, url || '#again', t + 1 + page_id % 5, 'revisit',
         CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '"stale"' WHEN page_id % 7 = 0 THEN NULL ELSE '"' || digest[1:16] || '"' END,
         CASE WHEN page_id % 13 = 0 THEN NULL ELSE digest END, 'content-length:0|date:' || (t + 1 + page_id % 5) || '|x-cache:hit', NULL FROM b
), u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM r),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(x, '^[^/?]*')), '^www[.]|:(?:80|443)$', '', 'g')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
       regexp_extract(x, '^[^/?]*(.*)$', 1), '([?&])utm_[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS url_key FROM u
), j AS (
  SELECT k.*, (SELECT max(struct_pack(captured := p.captured, record_id := p.record_id)).record_id FROM k p
               WHERE p.url_key = k.url_key AND p.type = 'response' AND p.captured < k.captured) AS ref FROM k
), s AS (
  SELECT j.*, p.digest AS then_digest, p.size AS then_size, CASE
    WHEN j.type = 'response' THEN 'response' WHEN p.record_id IS NULL THEN 'no_earlier_response'
    WHEN coalesce(j.etag = p.etag, j.digest = p.digest, false) THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM j LEFT JOIN k p ON p.record_id = j.ref
)
SELECT record_id, url_key, captured, type, status, CASE WHEN status IN ('resolved', 'validator_mismatch') THEN ref END AS refers_to,
       CASE WHEN status = 'resolved' THEN then_digest ELSE digest END AS digest,
       CASE WHEN status = 'resolved' THEN 'content-length:' || then_size || '|content-type:text/html|date:' || captured
            || '|etag:"' || then_digest[1:16] || '"|x-cache:hit' ELSE headers END AS headers
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_chat_format": OP7_SQL, "op9_warc_revisits": OP9_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_ring_shards": OP11_SQL, "op13_centroid_clusters": OP13_SQL}

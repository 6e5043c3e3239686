"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import balltree, bpe, gif, jaccard, mixing, pii, quality, secrets, sharding, suffix
from meshwright.llm.common import table

#: Fixed by the contracts.
VOCABULARY, QUERY_EVERY, TOP = "word_bpe_49k.json", 50, 5


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.topk(balltree.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % QUERY_EVERY == 0, TOP)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("class", "root")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_quality, op3_pii, op4_mixing, op5_sharding, op6_gif, op7_bpe, op8_topk, op9_suffix, op10_jaccard)
    return {f.__name__: f for f in own}


_OP4 = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT source, total, [5, 2, 1][place % 3 + 1]::BIGINT AS w, 2 * total AS cap, sum(total) OVER ()::BIGINT AS whole FROM src
), filled AS (
  SELECT *, cap / w::DOUBLE AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fixed,
    sum(w) OVER (ORDER BY cap / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM weighed
), level AS (
  SELECT arg_min((1.5::DOUBLE * whole - fixed) / rest::DOUBLE, ratio) AS lv FROM filled WHERE (1.5::DOUBLE * whole - fixed) / rest::DOUBLE < ratio
), aims AS (
  SELECT source, total, least(cap::DOUBLE, coalesce(lv, cap::DOUBLE) * w) AS target FROM weighed, level
), bounds AS (
  SELECT source, place, quota, coalesce(sum(quota) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM (SELECT s.source, s.place, ceil(a.target / 512)::BIGINT AS quota FROM src s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source) WHERE quota > 0
), total_slots AS (
  SELECT coalesce(sum(quota), 0)::BIGINT AS n FROM bounds
), points AS (
  SELECT slot, floor((slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE)) * n::DOUBLE)::BIGINT AS point FROM (SELECT n, unnest(range(n)) AS slot FROM total_slots)
), ranked AS (
  SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM points JOIN bounds ON point >= lo AND point < lo + quota
), placed AS (
  SELECT s.doc_id, s.source, s.size, a.total, a.target, floor(a.target)::BIGINT AS goal, x.place,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(s.h, 1, 6))::BIGINT % 4096, s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source JOIN src x ON s.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, source, size, total AS source_size, target,
  (greatest(0, least(b + size, goal) - b) + greatest(0, least(total + b + size, goal) - total - b))::BIGINT AS taken,
  CASE WHEN size > 0 AND b < goal THEN coalesce(p.slot, n + placed.place) END::BIGINT AS first_slot,
  CASE WHEN size > 0 AND total + b < goal THEN coalesce(q.slot, n + placed.place) END::BIGINT AS again_slot
FROM placed CROSS JOIN total_slots LEFT JOIN ranked p ON p.place = placed.place AND p.rank = b // 512 LEFT JOIN ranked q ON q.place = placed.place AND q.rank = (total + b) // 512
"""


def _law(node: str) -> str:
    """The draw of a child: -ln(u), u from the digest of doc_id and the child; all weights of a level are equal there."""
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{node}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


def _least(*options: tuple[str, str]) -> str:
    """The value of the child with the least draw, of two or three."""
    (a, x), (b, y) = options[:2]
    if len(options) == 2:
        return f"CASE WHEN {a} <= {b} THEN {x} ELSE {y} END"
    c, z = options[2]
    return f"CASE WHEN {a} <= {b} AND {a} <= {c} THEN {x} WHEN {b} <= {c} THEN {y} ELSE {z} END"


def _op5() -> str:
    shards = [_least((_law(f"s{k}"), str(k)), (_law(f"s{k + 1}"), str(k + 1))) for k in (0, 2, 4, 6)]
    regions = [_least((_law(f"g{g}/r0"), shards[2 * g]), (_law(f"g{g}/r1"), shards[2 * g + 1])) for g in (0, 1)]
    weighed = [f"({_law(f'g{g}')}) / {w}" for g, w in ((0, 4.0), (1, 4.0), (2, 1.0))]
    return f"""
WITH RECURSIVE crc(k, i, c) AS (
  SELECT k, 0, k FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE i < 8
), steps AS (
  SELECT list(c ORDER BY k) AS step FROM crc WHERE i = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_least((weighed[0], regions[0]), (weighed[1], regions[1]))} AS shard, {_least((weighed[0], regions[0]), (weighed[1], regions[1]), (weighed[2], '8'))} AS grown_shard,
    md5('slot:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), bytes AS (
  SELECT text, step, list_transform(range(0, strlen(text)), lambda k: ('0x' || substr(hex(encode(text)), 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT text FROM d), steps
), sums AS (
  SELECT text, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM bytes
), sized AS (
  SELECT doc_id, (strlen(d.text) + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, shard, grown_shard, h FROM d JOIN sums ON d.text = sums.text
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(h, 1, 6))::BIGINT % 4096, h, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard FROM sized
"""


_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""

_OP9 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS p FROM d)
), s AS (
  SELECT rid, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)
), runs AS (
  SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM s)
), spans AS (
  SELECT rid, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY rid, run
), pieces AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM spans
), cut AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM pieces JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)
"""

_OP10 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.x
)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _OP4, "op5_sharding": _op5(), "op8_topk": _OP8, "op9_suffix": _OP9, "op10_jaccard": _OP10}

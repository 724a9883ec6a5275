"""The registered queries of the operators on training text, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import (
    decontamination,
    exact_dedup,
    interpolation_lm,
    packing,
    preferences,
    resampling,
    sharding,
    simhash,
    suffix_dedup,
    token_alignment,
    toxicity,
    turn_repair,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the Hilbert curve into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write deduplicated archives of all pages and read every record back."""
    path = warc.deduplicated_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.headers_of(warc.read_archives(spark, path, keep_payload=False))


OP2_SQL = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), parts AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS target,
    list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT) AS five
  FROM heads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(five, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> target THEN target END AS refers_to
FROM parts
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept copy of every document, by tree-merged digest runs."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM normal WINDOW w AS (PARTITION BY text_sha256)
"""


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the interpolated model and the base model."""
    return interpolation_lm.scored(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, with the aligned span."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that an earlier one has."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen conversations against their echoed copies, shared turns rendered once."""
    return preferences.format_preferences(*preferences.echo_pairs(table(spark, sf_dir, "conversations")))


OP7_SQL = r"""
WITH ends AS (
  SELECT conv_id, first(text ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS opening,
    max(turn) FILTER (WHERE role = 'assistant') AS reply, count(*) FILTER (WHERE role = 'assistant') > 0 AS answered
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), sides AS (
  SELECT 'chosen' AS part, conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT 'rejected', c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN ends e USING (conv_id)
  WHERE NOT e.answered OR (e.reply IS NOT NULL AND (c.turn IS NULL OR c.turn < e.reply))
  UNION ALL
  SELECT 'rejected', conv_id, reply, 'assistant', opening FROM ends WHERE answered
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part, pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM sides
), differs AS (
  SELECT pair_id, place FROM placed GROUP BY pair_id, place
  HAVING count(*) <> 2 OR min(coalesce(role, chr(1))) <> max(coalesce(role, chr(1))) OR min(coalesce(text, chr(1))) <> max(coalesce(text, chr(1)))
), shared AS (
  SELECT p.pair_id, coalesce(min(d.place), max(p.place) + 1) AS shared
  FROM (SELECT pair_id, max(place) AS place FROM placed GROUP BY pair_id) p LEFT JOIN differs d USING (pair_id) GROUP BY p.pair_id
)
SELECT p.pair_id, CASE WHEN p.place < s.shared THEN 'prompt' ELSE p.part END AS part, p.place::BIGINT AS place, p.role,
  '<|' || coalesce(p.role, '') || '|>' || chr(10) || coalesce(p.text, '') || '<|end|>' || chr(10) AS rendered,
  p.place >= s.shared AND coalesce(p.role = 'assistant', false) AS train,
  CASE WHEN p.place >= s.shared AND p.role = 'assistant' THEN length('<|assistant|>') + 1 END AS train_from
FROM placed p JOIN shared s USING (pair_id)
WHERE p.place >= s.shared OR p.part = 'chosen'
"""

def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good text keeps."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by jump consistent hashing."""
    return sharding.placed(table(spark, sf_dir, "documents"))


# The 256 entries of the crc32 table, worked out from its polynomial, and a checksum folded over bytes.
CRC_TABLE = """
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(0, 8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(0, 256) r(n))
"""


def crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'),
    lambda h: ('0x' || h)::BIGINT)), lambda c, v: xor(crc[(xor(c, v) & 255) + 1], c >> 8)), 4294967295)"""


OP11_SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id FROM documents),
walk AS (
  SELECT id, (('0x' || substr(md5(id), 1, 16))::UBIGINT)::UHUGEINT AS state, 0::BIGINT AS home, 0 AS step FROM ids
  UNION ALL
  SELECT id, next, floor((home + 1) * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT, step + 1
  FROM (SELECT id, home, step, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS next FROM walk)
  WHERE floor((home + 1) * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE)) < 25
), homes AS (
  SELECT id, max(home) FILTER (WHERE home < 24) AS shard, max(home) AS grown_shard FROM walk GROUP BY id
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM sized JOIN homes ON id = coalesce(doc_id::VARCHAR, '')
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by the drill, repaired at least cost under the role grammar."""
    return turn_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


# The grammar as four places of a finite automaton: z nothing yet, s after system, u after user, p after a pair.
# A way is its cost in nine digits and its audit, so the least string is the least (cost, audit).
_NONE = "NULL::VARCHAR"


def _dearer(way: str, more: str, letter: str) -> str:
    return f"lpad((left({way}, 9)::BIGINT + {more})::VARCHAR, 9, '0') || substr({way}, 10) || '{letter}'"


OP12_SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS seat FROM conversations
), drawn AS (
  SELECT * EXCLUDE crc, {crc32_sql("seat")} % 20 AS draw FROM plain, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(0, 2) copies(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut,
    left(role, 1) AS initial
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged)
), judged AS (
  SELECT *, CASE WHEN is_blank THEN 'blank' WHEN seen THEN 'duplicate' WHEN is_cut THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM placed
), told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS place, '000000000' AS z, {_NONE} AS s, '000000003I' AS u, '000000006II' AS p FROM told
  UNION ALL
  SELECT conv_id, place, z, s, least(u, {_dearer("z", "3", "I")}, {_dearer("s", "3", "I")}, {_dearer("p", "3", "I")}),
    least(p, {_dearer("u", "3", "I")}, {_dearer("z", "6", "II")}, {_dearer("s", "6", "II")})
  FROM (
    SELECT w.conv_id, j.place,
      {_dearer("w.z", "4", "D")} AS z,
      least({_dearer("w.s", "4", "D")}, CASE WHEN fits AND initial = 's' THEN {_dearer("w.z", "late", "K")} END) AS s,
      least({_dearer("w.u", "4", "D")},
        CASE WHEN fits AND initial = 'u' THEN least({_dearer("w.z", "late", "K")}, {_dearer("w.s", "late", "K")}, {_dearer("w.p", "late", "K")}) END,
        CASE WHEN fits THEN least({_dearer("w.z", "3 + late", "R")}, {_dearer("w.s", "3 + late", "R")}, {_dearer("w.p", "3 + late", "R")}) END) AS u,
      least({_dearer("w.p", "4", "D")}, CASE WHEN fits AND initial = 'a' THEN {_dearer("w.u", "late", "K")} END,
        CASE WHEN fits THEN {_dearer("w.u", "3 + late", "R")} END) AS p
    FROM ways w JOIN (
      SELECT conv_id, place, initial, fault NOT IN ('blank', 'duplicate') AS fits, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM judged
    ) j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place + 1
  )
), best AS (
  SELECT w.conv_id, least(z, p) AS way FROM ways w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.place
), letters AS (
  SELECT conv_id, unnest(string_split(substr(way, 10), '')) AS letter, generate_subscripts(string_split(substr(way, 10), ''), 1) AS spot
  FROM best WHERE length(way) > 9
), moved AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS place, count(*) FILTER (WHERE letter <> 'D') OVER w AS said
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
), lines AS (
  SELECT m.conv_id, m.spot, m.said, m.letter, CASE WHEN m.letter = 'K' THEN j.role END AS kept, CASE WHEN m.letter = 'I' THEN '' ELSE j.text END AS text
  FROM moved m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.place = m.place WHERE m.letter <> 'D'
), spoken AS (
  SELECT *, bool_or(left(kept, 1) = 's' AND said = 1) OVER (PARTITION BY conv_id) AS led FROM lines
), whole AS (
  SELECT conv_id, string_agg(coalesce(kept, CASE WHEN (said + CASE WHEN coalesce(led, false) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END)
    || ':' || text, chr(10) ORDER BY spot) AS body
  FROM spoken GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(way, 9)::BIGINT, 0) AS cost,
  coalesce(substr(way, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two public tokenizers in every document."""
    return token_alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_preference_format": op7_preference_format,
    "op8_simhash_components": op8_simhash_components,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_toxicity": op10_toxicity,
    "op11_jump_sharding": op11_jump_sharding,
    "op12_turn_repair": op12_turn_repair,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op2_warc_revisits": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op7_preference_format": OP7_SQL,
    "op11_jump_sharding": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
}

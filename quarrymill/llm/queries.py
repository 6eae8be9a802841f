"""Queries over the operators of this subpackage, and SQL for those that SQL can express.

Beside each operator's own query stand some that return those of its columns that SQL can express, so that they are compared as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.chat import OP7_SQL, op7_chat
from quarrymill.llm.kneser_ney import op10_kneser_ney
from quarrymill.llm.lattice import op3_sentencepiece
from quarrymill.llm.media import op9_media
from quarrymill.llm.order_minhash import op8_order_minhash
from quarrymill.llm.packing import op5_packing
from quarrymill.llm.pii import op6_pii
from quarrymill.llm.sharding import op4_sharding
from quarrymill.llm.simhash import op1_simhash
from quarrymill.llm.toxicity import op2_toxicity


def side_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: each document's size and law."""
    return op4_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def side_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: how many base spans of each kind a document has."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def side_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: lengths and edited texts."""
    return op8_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def side_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: payloads as they were read back."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_toxicity, op3_sentencepiece, op4_sharding, op5_packing, op6_pii, op7_chat, op8_order_minhash, op9_media, op10_kneser_ney)
    return {f.__name__: f for f in (*found, side_shard_sizes, side_personal_data, side_edited_texts, side_payloads)}


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
SIDES = {
    "side_shard_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'rows' AS law, CAST(NULL AS INT) AS grown_shard FROM documents",
    "side_personal_data": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: len({_DIGITS}) BETWEEN 16 AND 19 AND
  list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE CAST(reverse({_DIGITS})[i] AS INT) * 2 - 9 * CAST(CAST(reverse({_DIGITS})[i] AS INT) > 4 AS INT) END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: len({_DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM d""",
    "side_edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 3 AS n FROM documents),
f AS (SELECT arg_max(t, doc_id) AS first FROM d), l AS (SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first) AS nxt FROM d, f)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - n) || left(nxt, n)) AS edited_sha256 FROM l""",
    "side_payloads": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents), p AS (SELECT doc_id, b, n, CASE WHEN n = 0 THEN 576 ELSE (576 - n % 576) % 576 END AS pad FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(b || repeat('\\xFF'::BLOB, pad)) AS payload_sha256 FROM p""",
}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL} | SIDES

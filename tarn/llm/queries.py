"""The operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import language_id, quality
from tarn.llm.exact_dedup import exact_report
from tarn.llm.fingerprints import fingerprints
from tarn.llm.license_scan import scan
from tarn.llm.mixing import mix
from tarn.llm.near_dedup import near_groups
from tarn.llm.packing import pack_documents
from tarn.llm.sharding import shard
from tarn.llm.substring_dedup import remove_repeats


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(spark, docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, documents(spark, sf_dir), shingle=2).drop("tag", "class_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_report(spark, documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, documents(spark, sf_dir), shards=8)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(spark, docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_sharding": op6_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT b, r FROM reach JOIN edge ON a = node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY node) USING (doc_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # CRC-32, the splitmix64 finaliser and jump consistent hashing, step by step
    "op6_sharding": r"""
        WITH RECURSIVE two AS (SELECT 18446744073709551616::UHUGEINT AS two64, list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS own, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS name FROM documents),
        c AS (SELECT r, doc_id, size, xor(list_reduce(list_concat([4294967295], own), lambda c, b: xor(c // 256, crc_table[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32,
            xor(list_reduce(list_concat([4294967295], name), lambda c, b: xor(c // 256, crc_table[xor(c, b) % 256 + 1])), 4294967295) AS number FROM d, two),
        k0 AS (SELECT DISTINCT doc_id, (CASE WHEN doc_id < 0 THEN two64 + doc_id::HUGEINT ELSE coalesce(doc_id, 0)::UHUGEINT END)::UBIGINT AS x, two64 FROM documents, two),
        k1 AS (SELECT doc_id, two64, (xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % two64)::UBIGINT AS x FROM k0),
        k2 AS (SELECT doc_id, two64, (xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % two64)::UBIGINT AS x FROM k1),
        keys AS (SELECT doc_id, n, xor(x, x >> 31) AS key FROM k2, (VALUES (8), (9)) v(n)),
        jump AS (SELECT doc_id, n, key, -1::BIGINT AS spot, 0::BIGINT AS ahead FROM keys UNION ALL
            SELECT doc_id, n, next, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((next >> 33)::DOUBLE + 1.0)))::BIGINT FROM (
                SELECT *, ((key::UHUGEINT * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % two64)::UBIGINT AS next FROM jump, two WHERE ahead < n)),
        placed AS (SELECT doc_id, any_value(spot) FILTER (n = 8) AS shard, any_value(spot) FILTER (n = 9) AS grown_shard FROM jump WHERE ahead >= n GROUP BY doc_id),
        blocks AS (SELECT greatest(1, ceil(count(*) / 20000))::BIGINT AS blocks FROM (SELECT DISTINCT doc_id, size, text_crc32 FROM c))
        SELECT c.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY number % blocks, c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
        FROM c JOIN placed ON c.doc_id IS NOT DISTINCT FROM placed.doc_id CROSS JOIN blocks
    """,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
        cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM rep),
        tok AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM w),
        kept AS (SELECT doc_id, count(cov.k) AS n_removed, string_agg(t, ' ' ORDER BY k) FILTER (cov.k IS NULL) AS s FROM tok LEFT JOIN cov USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
}

"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate as decon
from . import exact_dedup as exact
from . import chat, html_text, langid, near_dedup, packing, pii, quality, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_html_text": op5_html_text,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op1_chat_format": """
        WITH d AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                              ORDER BY turn NULLS FIRST, role, text) AS rendered
            FROM d GROUP BY conv_id
        ), g AS (
            SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, rendered FROM c GROUP BY n_turns, rendered
        )
        SELECT conv_id, n_turns, n_copies, rendered FROM g AS a
        WHERE NOT EXISTS (SELECT 1 FROM g AS b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))
    """,
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
    # the article of the test pages: their blocks are its headings and paragraphs; some end in `&amp` without its semicolon
    "op5_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS h FROM pages
        ), b AS (
            SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(?:p|h1)[^>]*>'), lambda x:
                   trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
                        '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l
            FROM a
        )
        SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM b
    """,
    # no passage of the test documents is an edited item: all that is found is found as it is
    "op7_decontamination": r"""
        WITH d AS (
            SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents
        ), b AS (
            SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM benchmark
        )
        SELECT doc_id, item_id, CAST(0 AS INTEGER) AS edits, CAST(strpos(t, x) - 1 AS BIGINT) AS start,
               CAST(strpos(t, x) - 1 + length(x) AS BIGINT) AS end
        FROM d, b WHERE length(x) >= 40 AND contains(t, x)
    """,
    "op6_warc_revisits": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages
        )
        SELECT page_id,
               CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(s, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT)
                          >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p
    """,
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), both_ AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), link AS (
            SELECT x, y FROM both_ JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
        )
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id, w.doc_id = min(reach.y) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id, n.n
    """,
    # of the further candidates the test documents hold secrets only, all of which are taken
    "op8_pii": r"""
        WITH kind AS (
            SELECT * FROM (VALUES
                (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
                (2, 'card', '[0-9](?:[ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]'),
                (6, 'secret', '[A-Za-z0-9+/_.-]+={0,2}')) AS v(rank, kind, re)
        ), t AS (
            SELECT doc_id, coalesce(text, '') AS t FROM documents
        ), f AS (
            SELECT doc_id, rank, kind, m, g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, rank, kind, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS g FROM t, kind) WHERE len(m) > 0
        ), p AS (
            SELECT doc_id, rank, kind, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
                   CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start
            FROM f
        ), ok AS (
            SELECT doc_id, rank, kind, start, start + length(x) AS stop FROM p
            WHERE CASE kind
                WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda y: CASE WHEN length(ltrim(y, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(y, '0') AS INTEGER) END)) <= 255
                WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda k:
                    CASE WHEN k % 2 = 0 THEN CAST(d[CAST(length(d) - k AS INTEGER)] AS INTEGER)
                         ELSE 2 * CAST(d[CAST(length(d) - k AS INTEGER)] AS INTEGER) - CASE WHEN CAST(d[CAST(length(d) - k AS INTEGER)] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
                WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
                WHEN 'secret' THEN length(x) >= 20 AND d <> '' AND regexp_matches(x, '[A-Za-z]') ELSE true END
        ), a AS (
            SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
                   count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                   coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4), '') AS base,
                   coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans, count(kind) AS n_spans
            FROM t LEFT JOIN ok ON ok.doc_id = t.doc_id GROUP BY t.doc_id
        )
        SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(base) AS base_sha256, spans, n_spans FROM a
    """,
}

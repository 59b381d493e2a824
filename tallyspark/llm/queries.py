"""The registered queries of the corpus operators and, where SQL can state their result, the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.attention_lm import score_texts
from tallyspark.llm.common import documents_of, shared_dir, tokenizer_file
from tallyspark.llm.conversations import repair
from tallyspark.llm.count_tree import jaccard_join
from tallyspark.llm.decontam import contaminated
from tallyspark.llm.divergence import divergence
from tallyspark.llm.exact_dedup import exact_dedup
from tallyspark.llm.lang_id import identify
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.rans import read_tokens, write_tokens
from tallyspark.llm.resample import SHARE, resample
from tallyspark.llm.rlz import remove_repeats
from tallyspark.llm.secrets_markov import find_secrets
from tallyspark.llm.sp_suffix import encode as sp_encode


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), share=SHARE)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents_of(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents_of(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents_of(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents_of(spark, sf_dir), path, tokenizer_file("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents_of(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_encode(documents_of(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents_of(spark, sf_dir))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents_of(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents_of(spark, sf_dir))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents_of(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_decontamination": op2_decontamination,
    "op6_token_files": op6_token_files,
    "op7_lm_scores": op7_lm_scores,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secrets": op9_secrets,
    "op3_near_duplicates": op3_near_duplicates,
    "op5_language_id": op5_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_source_divergence": op11_source_divergence,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ),
        g AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS h
            FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 2) END)) AS i FROM w)
        ),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, chr(10) ORDER BY h)) AS whole FROM g GROUP BY 1),
        r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS rep FROM n),
        u AS (SELECT g.doc_id, n, h FROM g JOIN r ON g.doc_id = r.doc_id AND r.doc_id = r.rep),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
            GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        c AS (
            SELECT rep AS id, rep AS low FROM r
            UNION
            SELECT e.b, c.low FROM c JOIN e ON e.a = c.id AND e.b > c.low
        ),
        m AS (SELECT id, min(low) AS low FROM c GROUP BY 1)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id, w.doc_id = coalesce(low, w.doc_id) AS kept
        FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN m ON m.id = r.rep
    """,
    "op10_repeated_passages": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS i FROM w)),
        r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        s AS (SELECT DISTINCT doc_id, i FROM k WHERE h IN (SELECT h FROM r)),
        t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
        c AS (SELECT t.doc_id, t.i, word, max(s.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
              FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND s.i = t.i),
        g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN g ON g.doc_id = w.doc_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (
            SELECT row AS doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS row FROM d)
        ),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
        v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM k GROUP BY 1),
        c AS (SELECT w.lang, source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
        p AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.n + 2 * v.v) AS p,
                   1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
            FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang
            LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
        ),
        s AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 4
            UNION ALL
            SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source WHERE a.lang NOT IN (SELECT lang FROM v)
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM s)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY i) AS of_byte
            FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))
        ),
        raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS key
            FROM conversations
        ),
        fated AS (
            SELECT conv_id, turn, role, text,
                   xor(list_reduce(list_prepend(4294967295, key), lambda x, b: xor(x >> 8, of_byte[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS fate
            FROM raw, crc
        ),
        damaged AS (
            SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM fated
        ),
        placed AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   right(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'), 1) AS last
            FROM damaged
        ),
        marked AS (
            SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
                   CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ),
        counted AS (
            SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                   count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                   count(*) FILTER (WHERE i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY 1
        ),
        ways AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' AS e, CAST(NULL AS VARCHAR) AS s, '0000000002I' AS u, '0000000004II' AS a FROM marked
            UNION ALL
            SELECT conv_id, i, e, s,
                   least(u, add_e || 'I', add_s || 'I', add_a || 'I'), least(a, printf('%010d', CAST(left(least(u, add_e || 'I', add_s || 'I', add_a || 'I'), 10) AS BIGINT) + 2) || substr(least(u, add_e || 'I', add_s || 'I', add_a || 'I'), 11) || 'I')
            FROM (
                SELECT conv_id, i, e, s, u, a,
                       printf('%010d', CAST(left(e, 10) AS BIGINT) + 2) || substr(e, 11) AS add_e,
                       printf('%010d', CAST(left(s, 10) AS BIGINT) + 2) || substr(s, 11) AS add_s,
                       printf('%010d', CAST(left(a, 10) AS BIGINT) + 2) || substr(a, 11) AS add_a
                FROM (
                    SELECT w.conv_id, m.i,
                           printf('%010d', CAST(left(e, 10) AS BIGINT) + 3) || substr(e, 11) || 'D' AS e,
                           least(printf('%010d', CAST(left(s, 10) AS BIGINT) + 3) || substr(s, 11) || 'D',
                                 CASE WHEN fault IN ('', 'truncated') AND initial = 's' THEN printf('%010d', CAST(left(e, 10) AS BIGINT) + CAST(fault <> '' AS INTEGER)) || substr(e, 11) || 'K' END) AS s,
                           least(printf('%010d', CAST(left(u, 10) AS BIGINT) + 3) || substr(u, 11) || 'D',
                                 CASE WHEN fault IN ('', 'truncated') AND initial = 'u' THEN printf('%010d', CAST(left(least(e, s, a), 10) AS BIGINT) + CAST(fault <> '' AS INTEGER)) || substr(least(e, s, a), 11) || 'K' END,
                                 CASE WHEN fault IN ('', 'truncated') THEN printf('%010d', CAST(left(least(e, s, a), 10) AS BIGINT) + 2 + CAST(fault <> '' AS INTEGER)) || substr(least(e, s, a), 11) || 'R' END) AS u,
                           least(printf('%010d', CAST(left(a, 10) AS BIGINT) + 3) || substr(a, 11) || 'D',
                                 CASE WHEN fault IN ('', 'truncated') AND initial = 'a' THEN printf('%010d', CAST(left(u, 10) AS BIGINT) + CAST(fault <> '' AS INTEGER)) || substr(u, 11) || 'K' END,
                                 CASE WHEN fault IN ('', 'truncated') THEN printf('%010d', CAST(left(u, 10) AS BIGINT) + 2 + CAST(fault <> '' AS INTEGER)) || substr(u, 11) || 'R' END) AS a
                    FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
                )
            )
        ),
        best AS (
            SELECT w.conv_id, CAST(left(least(e, a), 10) AS BIGINT) AS cost, substr(least(e, a), 11) AS audit
            FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
        ),
        letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''),
        numbered AS (
            SELECT conv_id, k, letter, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
        ),
        turned AS (
            SELECT n.conv_id, k, letter, j, m.role, m.text, max(CASE WHEN j = 1 AND letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS head
            FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.i = n.i AND letter <> 'I' WHERE letter <> 'D'
        ),
        hashed AS (
            SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS h FROM turned GROUP BY 1
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}

#: The links of op3 at 80 percent, without its column kept.
ORACLE_SQL["op12_jaccard_join"] = (
    ORACLE_SQL["op3_near_duplicates"].replace(">= 75 * (a.n", ">= 80 * (a.n").replace(", w.doc_id = coalesce(low, w.doc_id) AS kept", "")
)

"""The queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import (
    alignment, jaccard, langid, licenses, mixing, packing, pages, quality, structure, suffixes,
    tokens, urls, vectors,
)
from newsloom.llm.common import UPPER, WORD, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, F.col("vec_id") % 50 == 0, 5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("broken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_check(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return structure.repair(structure.damaged(rows), rows)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_topk_search, op2_best_fit_packing, op3_quality_rules, op4_language_id, op5_mixing,
        op6_token_files, op7_suffix_dedup, op8_main_text, op9_license_scan, op10_ngram_jaccard, op11_structure_repair,
        op12_url_filter, op13_cross_tokenizer, pipeline,
    )
}

def _quality_sql() -> str:
    """op3 in SQL: the counts of each text, and the rule table as one condition."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)
    ratios = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)",
    }
    bounds = [
        f"{ratios.get(r.metric, r.metric)} {sign} {bound}"
        for r in quality.RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x:
                    regexp_matches(x, '{quality.IN_WORD}')) AS lines
            FROM documents),
        w AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM d),
        g AS (
            SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c
            FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
        f AS (
            SELECT rid, i FROM g WHERE c IS NOT NULL
            QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
        e AS (
            SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS n
            FROM f),
        r AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY rid),
        m AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT)
                    AS word_chars,
                CAST(len(regexp_extract_all(t, '{quality.SYMBOL}')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
                len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words,
                len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper
            FROM d LEFT JOIN r USING (rid)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND {" AND ".join(bounds)} AS kept
        FROM b"""


SQL: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x:
                CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
                x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)
                    AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (
            SELECT *, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_quality_rules": _quality_sql(),
    # Sets are joined on their shingles; meant for the small table of the comparison.
    "op10_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                '{WORD}') AS words
            FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM d),
        g AS (
            SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c
            FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        s AS (
            SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS x FROM g WHERE c IS NOT NULL
            UNION ALL
            SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) IN (1, 2)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS m
            FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
        links AS (
            SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
            WHERE {jaccard.OF} * p.m >= {jaccard.PARTS} * (na.n + nb.n - p.m)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        k AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
        FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    # One step of the recursion takes the next row of every conversation, over four states:
    # 0 nothing yet, 1 after the system row, 2 after a user's, 3 after an assistant's.
    "op11_structure_repair": rf"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations),
        h AS (
            SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1),
                lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, x:
                list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, y:
                    xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS way
            FROM k),
        d AS (
            SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                    ELSE text END AS text,
                unnest(CASE WHEN way = 0 THEN CAST([] AS INTEGER[]) WHEN way = 3 THEN [1, 2] ELSE [1] END)
            FROM h),
        o AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
        n AS (
            SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST,
                md5(concat(length(role), ':', role, text))) AS i
            FROM d JOIN o ON d.conv_id IS NOT DISTINCT FROM o.conv_id),
        r AS (
            SELECT *, substr(role, 1, 1) AS x, lead(substr(role, 1, 1)) OVER (PARTITION BY cid ORDER BY i) AS y,
                CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
            FROM n),
        f AS (
            SELECT cid, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (x || y NOT IN ('su', 'ua', 'au')) AS illegal
            FROM r GROUP BY cid),
        step (src, x, dst) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        ins (src, dst, cost, audit, lines) AS (
            SELECT src, src, 0, '', '' FROM (VALUES (0), (1), (2), (3)) v (src)
            UNION ALL
            SELECT src, dst, 2, 'I', chr(10) || if(dst = 2, 'user:', 'assistant:') FROM step WHERE x <> 's'
            UNION ALL
            SELECT src, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:' FROM step
            WHERE dst = 2),
        w AS (
            SELECT cid, 0::BIGINT AS i, 0 AS st, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM o
            UNION ALL
            SELECT cid, i, st, min(best) FROM (
                SELECT w.cid, r.i, e.dst AS st, {{
                    'cost': CAST(w.best.cost + ins.cost + e.cost
                        + if(e.edit <> 'D' AND r.fault = 'truncated', 1, 0) AS BIGINT),
                    'audit': w.best.audit || ins.audit || e.edit,
                    'lines': w.best.lines || ins.lines || CASE e.edit WHEN 'D' THEN ''
                        WHEN 'K' THEN chr(10) || r.role || ':' || r.text
                        ELSE chr(10) || if(e.dst = 2, 'user:', 'assistant:') || r.text END}} AS best
                FROM w JOIN ins ON ins.src = w.st JOIN r ON r.cid = w.cid AND r.i = w.i + 1
                JOIN (
                    SELECT src, NULL AS x, dst, 'R' AS edit, 2 AS cost FROM step WHERE x <> 's'
                    UNION ALL SELECT src, x, dst, 'K', 0 FROM step
                    UNION ALL SELECT src, NULL, src, 'D', 3 FROM (VALUES (0), (1), (2), (3)) v (src)
                ) e ON e.src = ins.dst AND (e.edit = 'D' OR r.fault IN ('none', 'truncated'))
                    AND (e.edit <> 'K' OR e.x = r.x))
            GROUP BY cid, i, st),
        z AS (
            SELECT w.cid, min({{'cost': w.best.cost + ins.cost, 'audit': w.best.audit || ins.audit,
                'lines': w.best.lines || ins.lines}}) AS best
            FROM w LEFT JOIN f USING (cid) JOIN ins ON ins.src = w.st
            WHERE w.i = coalesce(f.size, 0) AND ins.dst IN (0, 3) GROUP BY w.cid)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
            coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, z.best.cost AS cost, z.best.audit AS audit,
            sha256(substr(z.best.lines, 2)) AS repaired_sha256
        FROM o JOIN z USING (cid) LEFT JOIN f USING (cid)""",
}

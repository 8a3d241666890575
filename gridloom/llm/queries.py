"""The query of each operator over its whole table, with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .line_dedup import line_dedup
from .mixing import mixture
from .near_dedup import near_dedup
from .ngram_join import ngram_join
from .packing import pack
from .pii import pii
from .quality_classifier import quality_scores
from .quality_rules import PHRASES, quality_rules
from .secret_scan import secret_scan
from .source_divergence import source_divergence
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    )
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by ordered lists of verified chunk identifiers."""
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by a hashed n-gram model learnt from the labels that aren't held out."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(
    "op4_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), k AS (
      SELECT doc_id, pos, line,
             translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l
    ), c AS (
      SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    )
    SELECT doc_id, count(*) AS n_lines, count(c.key) FILTER (WHERE doc_id <> last_doc) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                           FILTER (WHERE c.key IS NULL OR doc_id = last_doc), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in five documents or more go, but for those of the largest id."""
    return line_dedup(_table(spark, sf_dir, "documents"))


@_query(
    "op5_quality_rules",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), w AS (
      SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS pos
      FROM d
    ), tri AS (
      SELECT doc_id, pos, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3
      FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
    ), marked AS (
      SELECT doc_id, pos, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1)::INT AS again
      FROM tri
    ), covered AS (
      SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c
      FROM marked
    ), words AS (
      SELECT doc_id, count(*) AS n_words, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY doc_id
    ), l AS (
      SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
    ), j AS (
      SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
             length(line) - length(regexp_replace(line, '[|»·›•→]', '', 'g')) AS separators,
             trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
      FROM l
    ), f AS (
      SELECT *, (NOT regexp_matches(trimmed, '[.!?:;…。！？"''»”)\]]$')
                 AND NOT regexp_matches(trimmed, '[\x20\x09-\x0D][^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]'))
             OR symbols * 10 > chars
             OR length(regexp_extract_all(line, '[!?]{2,}')) >= 3
             OR (separators >= 3 AND separators * 12 >= length(line))
             OR (length(line) <= 300 AND len(list_filter([{PHRASES}], lambda p: contains(lower(line), p))) > 0) AS fails
      FROM j WHERE chars > 0
    ), lines AS (
      SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines,
             coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost
      FROM f GROUP BY doc_id
    ), base AS (
      SELECT d.doc_id, coalesce(n_words, 0) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(lost, 0) AS lost
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept
    FROM base
    """.replace("{PHRASES}", ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)),
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines judged first, then documents that lose too much."""
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.drop("lost_chars", "clean_text")


@_query(
    "op8_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) >= 5
                          THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
      FROM w
    ), one AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM sets
      UNION
      SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), root AS (
      SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
    )
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN root USING (doc_id)
    """,
)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at a similarity of 0.85 of five-word shingles."""
    return near_dedup(_table(spark, sf_dir, "documents"))


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed along a Hilbert curve into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to a mixture of its sources at their target weights."""
    return mixture(_table(spark, sf_dir, "documents"))


@_query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern, and the terms near it that give it away."""
    return pii(_table(spark, sf_dir, "documents"))


@_query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by character models."""
    return secret_scan(_table(spark, sf_dir, "documents"))


@_query("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through archives and back."""
    return warc_round_trip(_table(spark, sf_dir, "pages"))


@_query(
    "op11_filter_audit",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), marks AS (
      SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
    ), flags AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN marks USING (doc_id)
    ), counted AS (
      SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails
    ), orders AS (
      SELECT '' AS o
      UNION ALL
      SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
    ), steps AS (
      SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM orders WHERE length(o) = 5
    ), cases AS (
      SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, n, good, toxic,
             len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(substr(filter_order, 1, step - 1), x))) > 0 AS gone
      FROM counted, steps
    ), audit AS (
      SELECT part, filter_order, step, f,
             coalesce(sum(n) FILTER (WHERE NOT gone AND NOT contains(fails, f)), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE NOT gone AND contains(fails, f)), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE gone AND contains(fails, f)), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE NOT gone AND contains(fails, f)), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE NOT gone AND contains(fails, f)), 0)::BIGINT AS toxic_lost
      FROM cases GROUP BY part, filter_order, step, f
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM audit
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by source."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(
    "op13_source_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), tokens AS (
      SELECT r, lang, source,
             translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM d
    ), kept AS (
      SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
    ), size AS (
      SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang
    ), groups AS (
      SELECT DISTINCT lang, source FROM d
    ), own AS (
      SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), owned AS (
      SELECT lang, source, sum(n)::BIGINT AS total FROM own GROUP BY lang, source
    ), p AS (
      SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
             1 + (1000000000 * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * z.v) AS p,
             1 + (1000000000 * (k.n + 2)) // (z.total + 2 * z.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN size z USING (lang)
      LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
      LEFT JOIN owned t ON t.lang = g.lang AND t.source = g.source
    ), pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source
    ), every AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
    ), placed AS (
      SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every
    )
    SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 10
    """,
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of a language, and the terms that set a source apart."""
    return source_divergence(_table(spark, sf_dir, "documents"))


@_query(
    "op12_ngram_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) >= 5
                          THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
      FROM w
    ), one AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM sets
      UNION
      SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), root AS (
      SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
    )
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
    FROM sets JOIN root USING (doc_id)
    """,
)
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined at a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join(_table(spark, sf_dir, "documents"))

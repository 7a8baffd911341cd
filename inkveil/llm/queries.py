"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm.alignment import align_tokenizers
from inkveil.llm.common import apply_settings
from inkveil.llm.conversations import conversation_audit, damage
from inkveil.llm.decontaminate import contamination
from inkveil.llm.embedding_dedup import embedding_components
from inkveil.llm.license_scan import license_scan
from inkveil.llm.lm_scoring import lm_scores
from inkveil.llm.mixing import mix_sources
from inkveil.llm.ngram_join import ngram_components
from inkveil.llm.packing import pack
from inkveil.llm.pii import BASE_KINDS, as_text, pii_spans
from inkveil.llm.quality import quality_scores
from inkveil.llm.token_counts import token_counts
from inkveil.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under its name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words and distinct shingles of a text in SQL.
WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""
SHINGLES = """unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3),
        lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)"""


@query()
def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, {SHINGLES} AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh
              WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
              WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON d.doc_id = low.a""")
def op10_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


@query()
def op5_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", ";"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, {SHINGLES} AS sh FROM w),
    v AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
    t AS (SELECT DISTINCT item_id, {SHINGLES} AS sh FROM v),
    m AS (SELECT item_id, count(*) AS n_item FROM t GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN t USING (sh) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM c JOIN m USING (item_id) WHERE 100 * n_shared >= 75 * n_item""")
def op9_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_pii(spark, sf_dir):
    spans = F.col("spans")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return pii_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(as_text(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        as_text(spans).alias("spans"),
    )


@query()
def op8_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


VALID_VECTORS = """
    valid AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0)"""


@query(f"""
WITH RECURSIVE {VALID_VECTORS},
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label
              WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN low ON e.vec_id = low.a""")
def op3_embedding_dedup(spark, sf_dir):
    return embedding_components(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS mark FROM pages),
h AS (
    SELECT page_id, url, mark,
           CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN mark > 0 THEN regexp_extract(regexp_replace(substr(url, mark + 3), '^[^/?#]*', ''), '^[^?#]*')
                ELSE '' END AS path
    FROM p),
listed AS (SELECT * FROM (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
    ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'),
    ('net', '/fr/', 'net/fr/', 'block')) t(name, prefix, rule, verdict)),
fits AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM h) h JOIN listed l
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
    GROUP BY page_id),
t AS (
    SELECT page_id, token FROM (
        SELECT page_id, 'scheme:' || split_part(url, '://', 1) AS token FROM h WHERE mark > 0
        UNION SELECT page_id, 'host:' || unnest(list_filter(string_split(host, '.'), lambda x: x <> '')) FROM h
        UNION SELECT page_id, 'path:' || unnest(list_filter(
            string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> '')) FROM h
        UNION SELECT page_id, 'query:' || unnest(list_filter(list_transform(
            string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)),
            lambda x: x <> '')) FROM h)),
known AS (SELECT t.page_id, token, verdict FROM t JOIN fits USING (page_id)),
least AS (SELECT ceil(0.01::DOUBLE * count(DISTINCT page_id)) AS n FROM known),
sets AS (
    SELECT page_id, verdict, [token] AS tokens FROM known
    UNION ALL SELECT a.page_id, a.verdict, [a.token, b.token] FROM known a
        JOIN known b ON a.page_id = b.page_id AND a.token < b.token
    UNION ALL SELECT a.page_id, a.verdict, [a.token, b.token, c.token] FROM known a
        JOIN known b ON a.page_id = b.page_id AND a.token < b.token
        JOIN known c ON a.page_id = c.page_id AND b.token < c.token),
counts AS (SELECT tokens, verdict, count(*) AS n FROM sets GROUP BY ALL),
rules AS (
    SELECT tokens, verdict, n, n / sum(n) OVER (PARTITION BY tokens) AS confidence FROM counts),
strong AS (SELECT * FROM rules WHERE n >= (SELECT n FROM least) AND confidence >= 0.8),
kept AS (
    SELECT * FROM strong r WHERE NOT EXISTS (
        SELECT 1 FROM strong s WHERE s.verdict = r.verdict AND len(s.tokens) < len(r.tokens)
           AND list_has_all(r.tokens, s.tokens) AND s.confidence >= r.confidence)),
open AS (SELECT page_id, list(token) AS tokens FROM t WHERE page_id NOT IN (SELECT page_id FROM fits) GROUP BY page_id),
best AS (
    SELECT page_id, r.verdict, array_to_string(r.tokens, ' ') AS mined_rule,
           row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, n DESC, len(r.tokens),
                              array_to_string(r.tokens, ' '), r.verdict) AS k
    FROM open JOIN kept r ON list_has_all(open.tokens, r.tokens))
SELECT h.page_id, host, path, rule, coalesce(fits.verdict, best.verdict, 'allow') AS verdict, mined_rule
FROM h LEFT JOIN fits ON h.page_id = fits.page_id LEFT JOIN best ON h.page_id = best.page_id AND k = 1""")
def op1_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


@query()
def op7_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
keyed AS (
    SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size,
           md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(text))) AS drawn,
           greatest(0.05::DOUBLE, coalesce(length(translate(text, '0123456789<>{}[]()=;:/|_#@*+~^%$&', ''))::DOUBLE
               / nullif(length(text), 0) * (len(list_distinct(string_split(text, chr(10))))::DOUBLE
               / len(string_split(text, chr(10)))), 0)) AS weight FROM d),
docs AS (
    SELECT doc_id, source, size, drawn,
           -ln((('0x' || substr(drawn, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS key FROM keyed),
sizes AS (
    SELECT source, sum(size)::BIGINT AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM docs GROUP BY source),
-- Sources above their limit are set to it, until none is.
shared AS (
    SELECT 0 AS step, source, size, w, false AS capped, (SELECT sum(size) FROM sizes)::DOUBLE / (SELECT sum(w) FROM sizes) AS level
    FROM sizes
    UNION ALL
    SELECT step + 1, source, size, w, above, ((SELECT sum(size) FROM sizes) - sum(CASE WHEN above THEN 3 * size ELSE 0 END) OVER ())::DOUBLE
           / nullif(sum(CASE WHEN above THEN 0 ELSE w END) OVER (), 0)
    FROM (SELECT *, capped OR level * w > 3 * size AS above, bool_or(NOT capped AND level * w > 3 * size) OVER () AS again FROM shared)
    WHERE again),
targets AS (
    SELECT source, size AS source_size, CASE WHEN capped THEN 3.0 * size ELSE w * level END::DOUBLE AS target
    FROM shared WHERE step = (SELECT max(step) FROM shared)),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (
    SELECT d.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, drawn, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM docs d JOIN whole t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed""")
def op11_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- CRC-32, bit by bit.
kinds AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM named),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS i,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM damaged),
rows AS (
    SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
           CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
stats AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
-- States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
inserts AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'),
    (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''),
    (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:')) t(a, b, price, sign, turns)),
steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(b, initial, c)),
best AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'kept': ''} AS way FROM stats
    UNION ALL
    SELECT conv_id, i, state, min(way) FROM (
        SELECT r.conv_id, r.i, e.state, {'cost': best.way.cost + inserts.price + e.price,
               'audit': best.way.audit || inserts.sign || e.sign, 'kept': best.way.kept || inserts.turns || e.turn} AS way
        FROM best JOIN inserts ON inserts.a = best.state
        JOIN rows r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i + 1,
        LATERAL (
            SELECT inserts.b AS state, 4 AS price, 'D' AS sign, '' AS turn
            UNION ALL SELECT c, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || r.role || ':' || r.text
            FROM steps WHERE steps.b = inserts.b AND steps.initial = r.initial AND coalesce(r.fault, 'truncated') = 'truncated'
            UNION ALL SELECT c, CASE WHEN r.fault = 'truncated' THEN 6 ELSE 3 END, 'R',
                chr(10) || CASE WHEN steps.initial = 'u' THEN 'user:' ELSE 'assistant:' END || r.text
            FROM steps WHERE steps.b = inserts.b AND steps.initial <> 's' AND coalesce(r.fault, 'truncated') = 'truncated') e) x
    GROUP BY conv_id, i, state),
ended AS (
    SELECT s.conv_id, min({'cost': way.cost + price, 'audit': way.audit || sign, 'kept': way.kept || turns}) AS way
    FROM stats s JOIN best ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = s.n JOIN inserts ON inserts.a = best.state
    WHERE inserts.b IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.kept, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id""")
def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return conversation_audit(damage(conversations), conversations)


@query()
def op13_tokenizer_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"))


@query()
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)

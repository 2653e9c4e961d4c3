"""Thin queries over the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, clustering, decontaminate, language_model, lexical_search, line_dedup, near_dup, pii, quality, secret_scan, substring, toxicity, warc
from tallyframe.llm._shared import LOWER, UPPER, read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}



def vocabulary_path() -> str:
    """The byte-level vocabulary that the encoding query uses; it is read in place, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", *extra)


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest of them only."""
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE_SQL["op2_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, pos, coalesce(doc_id < top, false) AS dropped
           FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and the verdict of the compression bands."""
    return quality.score_quality(_docs(spark, sf_dir))


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by forced-boundary splitting, and the text that they decode to."""
    return bpe.round_trip(_docs(spark, sf_dir), vocabulary_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows, the items they come from and the contamination verdict."""
    found = decontaminate.contamination(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE_SQL["op10_decontaminate"] = f"""
WITH both_sides AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tokens AS (
  SELECT side, id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM both_sides),
items AS (SELECT DISTINCT id AS item, least(len(w), 13) AS n,
          unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: list_slice(w, i, i + least(len(w), 13) - 1))) AS win
          FROM tokens WHERE side = 'i' AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM items),
spans AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM tokens, sizes WHERE side = 'd' AND len(w) >= n),
hits AS (SELECT s.id, s.pos, s.n, i.item FROM spans s JOIN items i ON i.n = s.n AND i.win = list_slice(s.w, s.pos, s.pos + s.n - 1)),
words_hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY id),
items_hit AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY id)
SELECT t.id AS doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(t.w) AS contaminated
FROM tokens t LEFT JOIN words_hit h ON h.id = t.id LEFT JOIN items_hit i ON i.id = t.id WHERE t.side = 'd'
"""


def _joined(spans):
    """kind:start:stop of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by one pass of the combined automaton."""
    found = secret_scan.find_secrets(_docs(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(_count("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by patterns and the conditional random field."""
    found = pii.find_pii(_docs(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(_count("spans", k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def held_out(doc_id, parts: int):
    """Whether the remainder of the id's CRC-32 is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 2


@_query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for every page."""
    records = warc.derive(warc.responses_from_pages(read_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.array_join("headers", "|").alias("header_lines"),
    )


def _duck_uuid(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "'urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts)


def _duck_text(expr: str) -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for pattern, by in warc.TEXT_STEPS:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"
    return expr


_TITLE, _LANG, _LINK = (p.replace("'", "''") for p in (warc.TITLE, warc.LANG, warc.LINK))
ORACLE_SQL["op7_warc_derivatives"] = f"""
WITH source AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
response AS (SELECT *, {_duck_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "payload_digest")} AS refers_to FROM source),
records AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace(regexp_extract(payload, '{_TITLE}', 1), '[ \t\r\n]+', ' ', 'g'), ' ')
    || chr(13) || chr(10) || 'language: ' || regexp_extract(payload, '{_LANG}', 1)
    || chr(13) || chr(10) || 'outlinks: ' || len(regexp_extract_all(payload, '{_LINK}'))
    || chr(13) || chr(10) || 'http-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || strlen(payload)
    || chr(13) || chr(10) AS block FROM response
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_duck_text("payload")} FROM response),
named AS (SELECT *, {_duck_uuid("record_type", "refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest FROM records)
SELECT page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, strlen(block) AS content_length,
  'WARC-Type: ' || record_type || '|WARC-Record-ID: <' || record_id || '>|WARC-Date: {warc.DATE}|WARC-Target-URI: ' || target_uri
  || '|WARC-Refers-To: <' || refers_to || '>|WARC-Refers-To-Target-URI: ' || target_uri || '|WARC-Refers-To-Date: {warc.DATE}'
  || '|WARC-Source-Payload-Digest: ' || payload_digest || '|WARC-Block-Digest: ' || block_digest
  || '|Content-Type: ' || content_type || '|Content-Length: ' || strlen(block) AS header_lines
FROM named
"""


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the nearest labelled examples; learns from rows that are not held out."""
    docs = _docs(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 4))
    index = toxicity.fit(docs, labels)
    return toxicity.score(docs, index).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted", "evidence")


@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have 80 % of their union in common."""
    return near_dup.near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


@_query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and attention scores; both learn from the documents that are not held out."""
    import public_tokenizers

    ranks = language_model.read_ranks(spark, str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    docs = _docs(spark, sf_dir)
    fitted = language_model.fit(docs.where(~held_out("doc_id", 7)), ranks, bpe.PATTERN)
    scored = language_model.score(docs, fitted, ranks, bpe.PATTERN)
    return scored.select(
        "doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "per_token"
    )


@_query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside windows of 13 that start in a document with a smaller id go."""
    return substring.dedup_substrings(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL["op11_substring_dedup"] = """
WITH docs AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM docs WHERE len(w) >= 13),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS k FROM places),
lowest AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p FROM windows JOIN lowest USING (k) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT words.doc_id, count(*) - count(gone.p) AS n, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""


@_query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for each benchmark item."""
    return lexical_search.search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_lexical_search"] = f"""
WITH both_sides AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tokens AS (
  SELECT side, id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM both_sides),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM tokens WHERE side = 'd' AND len(w) > 0),
sizes AS (SELECT id AS doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * docs) // terms AS m FROM tokens, totals WHERE side = 'd'),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT id AS doc_id, unnest(w) AS term FROM tokens WHERE side = 'd') GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
asked AS (SELECT DISTINCT id AS item_id, unnest(w) AS term FROM tokens WHERE side = 'i'),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


@_query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds from 16 seeds."""
    assigned, centroids = clustering.cluster(read_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return clustering.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _duck_round(k: int) -> str:
    """Assign to the centroids of the round before, then move those that hold vectors."""
    return f"""
a{k} AS (SELECT vec_id, x, arg_min(cluster, d) AS cluster, CAST(min(d[1]) AS BIGINT) AS distance FROM (
  SELECT v.vec_id, v.x, c.cluster, [list_sum([(a - b) * (a - b) for a, b in zip]), c.cluster] AS d FROM v, c{k} c) GROUP BY vec_id, x),
c{k + 1} AS (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x FROM (
    SELECT cluster, p, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{k})
    GROUP BY cluster, p) GROUP BY cluster) n ON n.cluster = c.cluster)""".replace(
        "[(a - b) * (a - b) for a, b in zip]", "list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
    )


ORACLE_SQL["op13_centroid_clusters"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{",".join(_duck_round(k) for k in range(4))}
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 ON c3.cluster = a.cluster
"""

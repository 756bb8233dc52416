"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import ann, bpe, filter_audit, hard_negatives, imatch, language_id, license_scan, line_dedup, mixing, near_dedup, token_count, toxicity, url_trust
from quarrykit.llm.common import table
from quarrykit.llm.license_templates import TEMPLATES

BPE_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")


# The rules that the URL filter applies.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, BPE_PATH, bpe.build_lexicon(docs, BPE_PATH))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), TEMPLATES, least=0.75)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.predictions(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), language_id.held_out().alias("held_out")])


def op5_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out")])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"), percent=75)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = line_dedup.dedup(docs, threshold=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.count_tokens(table(spark, sf_dir, "documents"))
    return mixing.Draw(rows, entropy=0.95, repeats=4.0).rows(rows)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.whole_numbers(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


def op13_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(table(spark, sf_dir, "documents"), BYTE_BPE_PATH, limit=1024)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust, op2_bpe_transducer, op3_license_scan, op4_language_mixture, op5_additive_search, op6_toxicity, op7_near_duplicates,
        op8_imatch, op9_line_dedup, op10_temperature_mix, op11_filter_audit, op12_hard_negatives, op13_token_count,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k
GROUP BY doc_id
"""

ORACLE_SQL["op7_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w : w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sets sa ON sa.doc_id = a.doc_id JOIN sets sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(len(sa.s)) + any_value(len(sb.s)) - count(*))
), reach(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

_PRINTS = ", ".join(
    f"substr(md5(coalesce(string_agg(CASE WHEN ('0x' || substr(md5('{power}.{k}:' || term), 1, 2))::INT < {4 ** (4 - power)} AND term <> '' THEN term END, ' ' ORDER BY term), '')), 1, 12)"
    for power, n in imatch.SUBSETS
    for k in range(n)
)


def _likeness(a: str, b: str) -> str:
    none = f"'{imatch.NOTHING}'"
    used = f"len(list_filter(list_zip({a}, {b}), lambda z : z[1] <> {none} OR z[2] <> {none}))"
    same = f"len(list_filter(list_zip({a}, {b}), lambda z : z[1] = z[2] AND z[1] <> {none}))"
    return f"CASE WHEN {used} = 0 THEN 1.0::DOUBLE ELSE {same}::DOUBLE / {used} END"


ORACLE_SQL["op8_imatch"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), pairs AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM docs WINDOW w AS (ORDER BY doc_id DESC)
), texts AS (
  SELECT doc_id, 0 AS kind, text FROM pairs
  UNION ALL SELECT doc_id, 1, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) FROM pairs
), terms AS (
  SELECT doc_id, kind, unnest(list_concat([''], list_distinct(list_filter(string_split_regex(lower(text), '[ 	-
]+'), lambda w : w <> '')))) AS term FROM texts
), lexicon AS (
  SELECT term FROM terms WHERE kind = 0 AND term <> '' GROUP BY term
  HAVING count(*) BETWEEN greatest(0.001 * (SELECT count(*) FROM docs), 2) AND greatest(0.2 * (SELECT count(*) FROM docs), 0.001 * (SELECT count(*) FROM docs), 2)
  UNION ALL SELECT ''
), prints AS (
  SELECT doc_id, kind, [{_PRINTS}] AS p FROM terms JOIN lexicon USING (term) GROUP BY doc_id, kind
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_chars, sha256(e.text) AS edited_sha256,
  array_to_string(a.p, ':') AS fingerprint, array_to_string(b.p, ':') AS edited_fingerprint,
  {_likeness("a.p", "b.p")} AS near_edited, {_likeness("a.p", "c.p")} AS near_next
FROM pairs d JOIN texts e ON e.doc_id = d.doc_id AND e.kind = 1 JOIN prints a ON a.doc_id = d.doc_id AND a.kind = 0
JOIN prints b ON b.doc_id = d.doc_id AND b.kind = 1 JOIN prints c ON c.doc_id = d.next_id AND c.kind = 0
"""


def _propagation(kind: str, seed: str, a: str, b: str, rounds: int) -> str:
    """Common table expressions for one kind of rank, round by round."""
    first = f"""{kind}_edges AS (
  SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM links
), {kind}_base AS (SELECT host, {seed} AS score FROM shares WHERE {seed} > 0), {kind}_0 AS (SELECT * FROM {kind}_base)"""
    turns = [
        f"""{kind}_{k + 1} AS MATERIALIZED (
  SELECT host, sum(score) AS score FROM (SELECT * FROM {kind}_base UNION ALL SELECT b, 0.85::DOUBLE * share * score FROM {kind}_{k} JOIN {kind}_edges ON a = host) GROUP BY host
)"""
        for k in range(rounds)
    ]
    return ", ".join([first, *turns])


def _rules(pick: int) -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(f'{h}{p}', v)[pick]}'" for v, h, p in url_trust.by_length(URL_RULES))
    return f"CASE {fits} END"


_LINK = url_trust.LINK.replace("'", "''")
_ROUNDS = url_trust.rounds_for(url_trust.DAMPING, url_trust.RESIDUAL)
ORACLE_SQL["op1_url_trust"] = rf"""
WITH urls AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (SELECT page_id, host, path, {_rules(0)} AS rule, {_rules(1)} AS said FROM urls
), shares AS (
  SELECT host, count(*) AS pages, avg((coalesce(said, '') = 'allow')::INT) AS t, avg((coalesce(said, '') = 'block')::INT) AS d FROM ruled WHERE host <> '' GROUP BY host
), own AS (SELECT host, regexp_extract(host, '{url_trust.domain_pattern(url_trust.SUFFIXES)}', 1) AS domain, pages FROM shares
), links AS (
  SELECT src, dst, sum(n)::DOUBLE AS n FROM (
    SELECT src, dst, 1 AS n FROM (
      SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM urls
    ) WHERE src <> dst AND src <> ''
    UNION ALL SELECT host, domain, pages FROM own WHERE domain NOT IN ('', host)
    UNION ALL SELECT domain, host, pages FROM own WHERE domain NOT IN ('', host)
  ) GROUP BY src, dst
), {_propagation("trust", "t", "src", "dst", _ROUNDS)}, {_propagation("distrust", "d", "dst", "src", _ROUNDS)}
, hosts AS (
  SELECT host, coalesce(t.score, 0) AS t, coalesce(d.score, 0) AS d FROM shares h
  LEFT JOIN trust_{_ROUNDS} t USING (host) LEFT JOIN distrust_{_ROUNDS} d USING (host)
), bad AS (SELECT host FROM hosts WHERE d > t AND d > (SELECT avg(d) + stddev_pop(d) FROM hosts))
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN r.said IS NOT NULL THEN 'rule' WHEN r.host <> '' THEN 'host' ELSE 'none' END AS decided_by
FROM ruled r LEFT JOIN bad b ON b.host = r.host
"""

ORACLE_SQL["op11_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents
), said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, concat(
      CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM docs d LEFT JOIN said USING (doc_id)
), kinds AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY part, fails
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), met AS (
  SELECT *, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda f : instr(filter_order, f))), 6) AS first FROM kinds, orders
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
    sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN first < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM met, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM steps
"""

ORACLE_SQL["op12_hard_negatives"] = r"""
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c : floor(256 * c::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

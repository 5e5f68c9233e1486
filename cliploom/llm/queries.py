"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, conversation_trie, divergence, licenses, line_dedup, packing, pivots, ppm, simhash, suffix_dedup, toxicity, url_filter

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
WORD_FILE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rules")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, whole=False)


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_lines", "n_removed", "n_runs", "sha2(kept, 256) AS kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), whole=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are no recordings: each conversation is rendered as one, turn after turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    texts = turns.groupBy(F.col("conv_id").alias("rec_id")).agg(F.array_join(F.array_sort(F.collect_list("t"))["text"], "\n").alias("text"))
    return chroma.align_recordings(chroma.recordings_of(texts))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.language_id(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are laid out by source and doc_id, those of one line a folder higher and as notices of it."""
    docs = table(spark, sf_dir, "documents")
    lower = F.when(F.contains("text", F.lit("\n")), F.expr("doc_id div 500").cast("string"))
    path = F.concat_ws("/", "source", F.expr("doc_id div 5000").cast("string"), lower, F.concat(F.when(lower.isNull(), "NOTICE-").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.license_scan(docs.select("doc_id", path.alias("path"), "text"))


#: Rules of the query, and names of hosts that are blocked wherever no rule fits.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LISTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ZONES = ("example.com", "example.net", "example.org")


def url_lists(spark: SparkSession) -> DataFrame:
    rows = [*RULES, *((f"{name}.{zone}", "listed") for name in LISTED for zone in ZONES)]
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("list")) for k, v in rows))).alias("x")).select("x.*")


def op11_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_lists(spark))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.grafted(turns)).drop("name", "parent")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_bpe": op3_bpe,
        "op4_pivots": op4_pivots,
        "op5_line_dedup": op5_line_dedup,
        "op6_packing": op6_packing,
        "op7_simhash": op7_simhash,
        "op8_chroma": op8_chroma,
        "op9_ppm": op9_ppm,
        "op10_licenses": op10_licenses,
        "op11_url_cascade": op11_url_cascade,
        "op12_divergence": op12_divergence,
        "op13_prefix_trie": op13_prefix_trie,
    }


#: A run of three lines that also begins earlier, by doc_id, text and line, takes its lines away.
LINE_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ids AS (SELECT DISTINCT doc_id, text FROM d),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS s FROM ids
),
runs AS (
  SELECT doc_id, text, s, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY s)
),
ranked AS (
  SELECT doc_id, text, s, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id NULLS FIRST, text, s) AS nth FROM runs WHERE l3 IS NOT NULL
),
gone AS (SELECT DISTINCT doc_id, text, s + k AS s FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
marked AS (
  SELECT l.doc_id, l.text, l.s, l.line, g.s IS NOT NULL AS gone, lag(g.s IS NOT NULL) OVER (PARTITION BY l.doc_id, l.text ORDER BY l.s) AS before
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.s = g.s
),
done AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT coalesce(before, false)) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY s) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, n_lines, n_removed, n_runs, kept_sha256 FROM d JOIN done ON d.doc_id IS NOT DISTINCT FROM done.doc_id AND d.text = done.text
"""


LICENSES = f"""
WITH templates(k, license, text) AS (VALUES {", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(licenses.flat(licenses.TEMPLATES)))}),
t AS (SELECT k, license, term, count(*) AS tf FROM (SELECT k, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
d AS (
  SELECT doc_id, concat_ws('/', source, CAST(doc_id // 5000 AS VARCHAR), CASE WHEN contains(text, chr(10)) THEN CAST(doc_id // 500 AS VARCHAR) END, CASE WHEN contains(text, chr(10)) THEN '' ELSE 'NOTICE-' END || CAST(doc_id AS VARCHAR) || '.txt') AS path, coalesce(text, '') AS text FROM documents
),
size AS (SELECT count(*) AS n FROM d),
lines AS (SELECT doc_id, path, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM (SELECT DISTINCT * FROM d)),
tokens AS (SELECT doc_id, path, line, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM lines),
df AS (SELECT term, count(DISTINCT (doc_id, path)) AS df FROM tokens WHERE term IN (SELECT term FROM t) GROUP BY term),
idf AS (SELECT v.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM t) v LEFT JOIN df USING (term), size),
units AS (SELECT * FROM tokens UNION ALL SELECT doc_id, path, -1, term FROM tokens UNION ALL SELECT doc_id, path, -2, term FROM tokens WHERE line <= {licenses.OPENING} AND regexp_matches(path, '{licenses.NAMED}')),
tf AS (SELECT doc_id, path, line, i.term, count(*) AS tf, any_value(idf) AS idf FROM units u LEFT JOIN idf i ON u.term = i.term GROUP BY doc_id, path, line, i.term),
norms AS (
  SELECT doc_id, path, line, sqrt(sum(CASE WHEN term IS NULL THEN tf * power(ln(n + 1) + 1, 2) ELSE tf * tf * idf * idf END)) AS norm FROM tf, size GROUP BY doc_id, path, line
),
lengths AS (SELECT k, license, sqrt(sum(tf * tf * idf * idf)) AS norm FROM t JOIN idf USING (term) GROUP BY k, license),
dots AS (SELECT doc_id, path, line, k, sum(tf.tf * t.tf * idf * idf) AS dot FROM tf JOIN t USING (term) GROUP BY doc_id, path, line, k),
scores AS (SELECT doc_id, path, line, k, license, round(dot / norms.norm / lengths.norm, 6) AS score FROM dots JOIN norms USING (doc_id, path, line) JOIN lengths USING (k)),
firsts AS (SELECT *, first_value(license) OVER (PARTITION BY doc_id, path, line ORDER BY score DESC, k) AS top FROM scores),
clear AS (SELECT doc_id, path, line, any_value(top) AS license, max(score) AS score, max((score, -k)) AS best FROM firsts GROUP BY doc_id, path, line HAVING coalesce(max(score) - max(score) FILTER (license <> top) >= {licenses.MARGIN}, true)),
header AS (SELECT doc_id, path, arg_max(license, best) AS license, max(score) AS score FROM clear WHERE line > 0 GROUP BY doc_id, path HAVING max(score) >= {licenses.HEADER}),
reads AS (SELECT doc_id, path, arg_max(license, best) AS license, max(score) AS score, max(best) AS best FROM clear WHERE line < 0 GROUP BY doc_id, path HAVING max(score) >= {licenses.FILE}),
stated AS (SELECT DISTINCT doc_id, path, regexp_extract(text, '{licenses.SPDX}', 1) AS license, 1.0::DOUBLE AS score, (1.0::DOUBLE, 1) AS best FROM d WHERE regexp_extract(text, '{licenses.SPDX}', 1) <> ''),
whole AS (SELECT * FROM stated UNION ALL SELECT * FROM reads WHERE (doc_id, path) NOT IN (SELECT (doc_id, path) FROM stated)),
granted AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, arg_max(license, best) AS license, max(score) AS score FROM whole WHERE regexp_matches(path, '{licenses.NAMED}') GROUP BY 1),
folders AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM d),
upward AS (SELECT folder, depth, array_to_string(string_split(folder, '/')[1:depth], '/') AS up FROM (SELECT folder, unnest(range(1, len(string_split(folder, '/')) + 1)) AS depth FROM folders)),
nearest AS (SELECT folder, arg_max(license, depth) AS license, arg_max(score, depth) AS score FROM upward JOIN granted USING (up) GROUP BY folder)
SELECT d.doc_id, d.path, coalesce(w.license, h.license, n.license) AS license, coalesce(w.score, h.score, n.score, 0) AS score,
  CASE WHEN w.license IS NOT NULL AND regexp_matches(d.path, '{licenses.NAMED}') THEN 'file' WHEN w.license IS NOT NULL OR h.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis
FROM d LEFT JOIN whole w ON d.doc_id = w.doc_id AND d.path = w.path LEFT JOIN header h ON d.doc_id = h.doc_id AND d.path = h.path
LEFT JOIN nearest n ON regexp_extract(d.path, '^(.*)/[^/]*$', 1) = n.folder
"""


ALPHABET = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"

URLS = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {ALPHABET}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
rules(rule, h, p, verdict) AS (VALUES {", ".join(f"('{k}', '{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{v}')" for k, v in RULES)}),
listed(h) AS (VALUES {", ".join(f"('{name}.{zone}')" for name in LISTED for zone in ZONES)}),
hosts AS (
  SELECT DISTINCT host, EXISTS (SELECT 1 FROM listed WHERE host = h OR ends_with(host, '.' || h)) AS bad FROM p
),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path JOIN hosts ON p.host = hosts.host
"""

DIVERGENCE = f"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, {ALPHABET}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
own AS (SELECT lang, source, term, n, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cells JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN v USING (lang)),
paid AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN paid p ON a.lang = p.lang AND a.source = p.source AND b.source = p.item),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.RANKS}
"""

#: crc32 goes bit by bit over the decimal number; a node's name strings the digests of its turns together.
TRIE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
crc(conv_id, s, i, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM t
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT crc.conv_id, xor(v, 4294967295) % 4 AS h, crc.conv_id - crc.conv_id % 20 AS base, n, least(xor(v, 4294967295) % 4, coalesce(n_base, 0)) AS taken
  FROM crc JOIN n ON crc.conv_id = n.conv_id LEFT JOIN (SELECT conv_id AS base, n AS n_base FROM n) b ON b.base = crc.conv_id - crc.conv_id % 20 WHERE i = 8 * length(s)
),
turns AS (
  SELECT c.conv_id, pos - h + taken + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
  UNION ALL SELECT c.conv_id, pos + 1, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < taken
),
m AS (
  SELECT conv_id, depth, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS name, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
),
sizes AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY conv_id),
nodes AS (SELECT name, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (n = depth), '') AS ends FROM m JOIN sizes ON m.conv_id = sizes.conv_id GROUP BY name, depth),
edges AS (SELECT u.name, m.name AS parent FROM nodes u JOIN m ON m.conv_id = u.conv_id AND m.depth = u.depth - 1),
kids AS (SELECT parent AS name, count(*) AS n_children FROM edges GROUP BY parent),
own AS (SELECT u.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes u LEFT JOIN kids USING (name)),
sums AS (SELECT m.name, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM own u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.name)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM own u JOIN sums ON u.name = sums.name LEFT JOIN edges ON edges.name = u.name LEFT JOIN nodes p ON p.name = edges.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op10_licenses": LICENSES, "op11_url_cascade": URLS, "op12_divergence": DIVERGENCE, "op13_prefix_trie": TRIE}

"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import decontaminate, exact_dedup, html_text, language_id, line_quality, merkle, mixing, near_dedup, secrets, token_count, tokenizer_align, toxicity, url_templates
from blockweave.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).drop("found")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_chars")


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(read(spark, sf_dir, "documents"), width=2).drop("key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op11_tokenizer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_align.alignment(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(read(spark, sf_dir, "documents"), seen=merkle.lowered_for()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_count": op3_token_count,
    "op4_language_id": op4_language_id,
    "op5_line_quality": op5_line_quality,
    "op6_url_templates": op6_url_templates,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mix_sources": op9_mix_sources,
    "op10_html_text": op10_html_text,
    "op11_tokenizer_align": op11_tokenizer_align,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS deal FROM documents),
z AS (SELECT doc_id, source, deal, CAST(coalesce(n, 0) AS BIGINT) AS size FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, most / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS whole FROM w),
f AS (SELECT *, whole - coalesce(sum(most) OVER b, 0) > ratio * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS is_full FROM r
      WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE (whole - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM f),
p AS (SELECT z.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
      CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.deal, z.doc_id NULLS FIRST, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT b, item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT b, item, size, k AS p, array_to_string(list_slice(w, k, k + size - 1), ' ') AS t FROM bk),
dk AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
dw AS (SELECT r, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS t FROM dk, (SELECT DISTINCT size FROM win) WHERE k + size - 1 <= len(w)),
hit AS (SELECT r, k, dw.size, b, item, p FROM dw JOIN win USING (size, t)),
run AS (SELECT *, k - row_number() OVER (PARTITION BY r, b, k - p ORDER BY k) AS g FROM hit),
far AS (SELECT r, min(k) - 1 AS place, count(*) + min(size) - 1 AS words FROM run GROUP BY r, b, k - p, g),
top AS (SELECT r, max(words) AS longest_match, arg_min(place, (-words, place)) AS longest_at FROM far GROUP BY r),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match, CAST(longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN top USING (r)
"""

_OP7 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT r, w, unnest(range(1, greatest(2, len(w)))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, k, k + 1), ' ') AS t FROM k),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
sn AS (SELECT * FROM s JOIN n USING (r)),
p AS (SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS c FROM sn a JOIN sn b ON a.t = b.t AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (an + bn - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
q AS (SELECT r AS a, r AS b FROM d UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a),
c AS (SELECT q.a AS r, min(d.doc_id) AS component_id FROM q JOIN d ON d.r = q.b GROUP BY q.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id, component_id IS NULL OR doc_id = component_id AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
b AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM a WHERE len(w) >= 3),
c AS (SELECT r, k, count(*) OVER (PARTITION BY r, list_slice(w, k, k + 2)) AS n FROM b),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
e AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT r, host, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS norm FROM e),
g AS (SELECT * FROM f WHERE chars > 0),
s AS (SELECT r, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS n_dup FROM g GROUP BY r),
h AS (SELECT r, md5(string_agg(DISTINCT norm, chr(10) ORDER BY norm)) AS whole FROM g GROUP BY r),
i AS (SELECT DISTINCT host, norm, whole FROM g JOIN h USING (r)),
j AS (SELECT host, norm FROM i GROUP BY host, norm HAVING count(*) > 10),
l AS (SELECT r, sum(chars) AS boilerplate FROM g JOIN j USING (host, norm) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(boilerplate, 0) AS BIGINT) AS boilerplate_chars
      FROM d JOIN a USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r) LEFT JOIN l USING (r)),
o AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (word_chars - boilerplate_chars < word_chars * 0.2::DOUBLE) AS kept FROM o
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r)
"""

_OP13 = r"""
WITH RECURSIVE p AS (SELECT doc_id, coalesce('=' || source, '') AS key, source, lang, n_chars, text,
      xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)),
        lambda a, b: list_reduce(range(8), lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 5 = 0 AS hit FROM documents),
f AS (SELECT doc_id, key, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS own, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END] AS other FROM p),
h AS (SELECT doc_id, key, sha256(array_to_string(list_transform(own, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf, sha256(array_to_string(list_transform(other, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS seen FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM h),
t AS (SELECT 0 AS lvl, key, idx, n, leaf AS digest FROM l
      UNION ALL SELECT lvl + 1, key, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, key, idx // 16, n),
s AS (SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, n, subroot AS digest FROM s
      UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 16, n),
a AS (SELECT key AS tree, * EXCLUDE (key) FROM t UNION ALL SELECT '#top', * FROM u),
b AS (SELECT tree, lvl, idx, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
      FROM a WINDOW w AS (PARTITION BY tree, lvl, idx // 16 ORDER BY idx)),
g AS (SELECT row_number() OVER () AS r, key, key AS tree, 0 AS lvl, idx, seen AS acc, '' AS proof, false AS done FROM l
      UNION ALL SELECT g.r, g.key, CASE WHEN b.n > 1 THEN g.tree ELSE '#top' END, CASE WHEN b.n > 1 THEN g.lvl + 1 ELSE 0 END, CASE WHEN b.n > 1 THEN g.idx // 16 ELSE s.idx END,
      CASE WHEN b.n > 1 THEN sha256(lft || acc || rgt) ELSE acc END, CASE WHEN b.n > 1 THEN proof || lft || rgt ELSE proof END, b.n = 1 AND g.tree = '#top'
      FROM g JOIN b ON b.tree = g.tree AND b.lvl = g.lvl AND b.idx = g.idx JOIN s ON s.key = g.key WHERE NOT done),
o AS (SELECT row_number() OVER () AS r, doc_id, leaf, key FROM l)
SELECT o.doc_id, o.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(g.proof) AS proof_sha256, g.acc AS folded_root, g.acc = (SELECT digest FROM u WHERE n = 1) AS verified
FROM o JOIN g ON g.r = o.r AND g.done JOIN s ON s.key = o.key
"""

ORACLE_SQL: dict[str, str] = {"op13_merkle_manifest": _OP13, "op12_exact_dedup": _OP12, "op5_line_quality": _OP5, "op1_decontaminate": _OP1, "op7_near_dedup": _OP7, "op9_mix_sources": _OP9}

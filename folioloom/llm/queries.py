"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language, media, near_dedup, packing, pii, quality, repeats, spelling, token_counts, urls, whitening
from .common import Shelf, table


#: Exact Jaccard over an inverted list of shingles, then reachability.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words
), sized AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT s FROM sets GROUP BY s HAVING count(*) > 1),
few AS (SELECT doc_id, s FROM sets SEMI JOIN shared USING (s)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM few a JOIN few b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


#: Every run of words of each window length, joined to the windows by their whole text.
OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT l FROM win),
dg AS (
  SELECT doc_id, l, i, array_to_string(w[i:i+l-1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lengths)
), hit AS (SELECT doc_id, i, dg.l AS l, item_id FROM dg JOIN win ON dg.l = win.l AND dg.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(Shelf(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents"), pii.train(spark))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.withColumn("held_out", F.coalesce(language.fold(F.col("doc_id")) == 1, F.lit(False)))


#: What the template writes, counted turn by turn; the turns and texts themselves.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '###', '\h') AS x,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '###', '\h'), ':', '\c') AS r,
    lag(role) OVER w AS past, lead(role) OVER w AS next
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN past = role THEN 5 ELSE 6 + length(r) END + CASE WHEN next = role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.format_chats(turns).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]

#: Rules by suffix and prefix, longest first; pages without one by the urls that canonical links and refreshes reach.
OP7_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
links AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM (SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<template\b.*?(?:</template\s*>|\z)', ' ', 'g') AS html FROM pages)
), urls AS (
  SELECT url FROM pages UNION
  SELECT CASE WHEN target LIKE '//%' THEN 'http:' || target WHEN target LIKE '/%' THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*', 0) || target ELSE target END FROM links WHERE target <> ''
), parts AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls)
), judged AS (
  SELECT url, any_value(host) AS host, any_value(path) AS path, any_value(CASE WHEN host <> '' THEN host || CASE WHEN tail = '' THEN '/' ELSE tail END END) AS node,
    arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS own
  FROM parts LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY url
), edges AS (
  SELECT a.node AS u, b.node AS v FROM links JOIN judged a ON a.url = links.url
  JOIN judged b ON b.url = CASE WHEN target LIKE '//%' THEN 'http:' || target WHEN target LIKE '/%' THEN regexp_extract(links.url, '^[^:/?#]*://[^/?#]*', 0) || target ELSE target END
  WHERE target <> '' AND a.node IS NOT NULL AND b.node IS NOT NULL
), sides AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u, v FROM sides UNION SELECT r.u, b.v FROM reach r JOIN sides b ON b.u = r.v),
passed AS (SELECT r.u AS node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS said FROM reach r JOIN judged j ON j.node = r.v GROUP BY r.u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, said, 'allow') AS verdict
FROM pages LEFT JOIN judged ON judged.url = pages.url LEFT JOIN passed ON passed.node = judged.node
"""


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


#: All 50-byte windows as hex digits, the least document of each, and what the others' windows cover.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, 512 * c AS base, substr(h, 1024 * c + 1, 1122) AS g FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 511) // 512)) AS c FROM d)),
w AS (SELECT doc_id, base + i AS i, substr(g, 2 * i + 1, 100) AS s FROM (SELECT doc_id, base, g, unnest(range(0, least(512, len(g) // 2 - 49))) AS i FROM part)),
shared AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN shared USING (s) WHERE doc_id > least),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM run),
left_over AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS before FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN left_over ON left_over.doc_id = d.doc_id
"""


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The checksum by its table of 256 steps; near words by the texts that one deletion leaves; forms followed to their ends.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))
), runs AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
  ) WHERE length(w) >= 5 GROUP BY doc_id, w
), bytes AS (
  SELECT w, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM runs
), hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed
), vocabulary AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN vocabulary v ON v.word = l.d
  UNION SELECT v.word, l.word, l.n FROM less l JOIN vocabulary v ON v.word = l.d
), ranked AS (
  SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM near
), formed AS (
  SELECT v.word AS word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM vocabulary v LEFT JOIN ranked ON ranked.word = v.word AND k = 1
), walk AS (
  SELECT word, word AS here FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.here WHERE form IS NOT NULL
)
SELECT formed.word AS word, n, n_near, formed.form AS form, form_n, here AS root
FROM formed JOIN walk ON walk.word = formed.word JOIN (SELECT word AS last FROM formed WHERE form IS NULL) ON last = here
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.predict(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


QUERIES = [op1_near_dedup, op2_media, op3_decontamination, op4_pii, op5_language, op6_chat, op7_urls, op8_packing, op9_token_counts, op10_repeats, op11_spelling, op12_whitening, op13_quality]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op6_chat": OP6_SQL, "op7_urls": OP7_SQL, "op10_repeats": OP10_SQL, "op11_spelling": OP11_SQL}

"""Queries over headings, contents pages, sections, images and spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import profile as P
from ..functions import text as T
from ..operators import images as I
from ..operators import lines as L
from ..operators import sections as S
from ..operators import spine as Z
from ..operators.pixels import pixel_statistics
from ..sources.tables import book_pages, table
from . import Query
from . import sqltext as D
from .pages import fold_sql, lines_sql, separator_sql
from .sqltext import Rows

PARAS = Rows(
    "id, a, b",
    "(1, 'Capítulo 1: Lanzamiento', 'un cuerpo largo'), (2, 'Prólogo', 'Monólogo De Atsuomi'), (3, 'Parte 2', 'nada de nada'), (4, 'PART 3', 'nada'), (5, 'Capítulo IV', 'nada'), (6, '1. Inicio del viaje', 'nada'), (7, 'Interludio', 'nada'), (8, 'Epílogo', 'nada'), (9, 'Short Story', 'La Luna Roja'), (10, 'Afterword', 'Palabras del autor'), (11, 'texto corriente', 'Capítulo 5'), (12, 'Agradecimientos', 'Gracias'), (13, 'Capítulo extra', 'El Último Día'), (14, 'Omake', 'Fin'), (15, 'Capítulo 7', 'Prólogo'), (16, 'Chapter 12 - The End', 'x'), (17, '', 'Introducción')",
    ("100 + k", D.one_of(1, "'Capítulo ' || n || ': ' || priority", "'Parte ' || n", "'Prólogo'", "'Epílogo'", "'Short Story'", "n || '. Inicio del viaje'", "'— Chapter IV —'", "'Afterword'", "'Agradecimientos'", "''", "'texto ' || k"), D.one_of(2, "'La Luna Roja'", "'nada de nada'", "'Palabras del autor'", "'Prólogo'", "'Capítulo ' || n", "priority")),
)
TOC_PAGES = Rows(
    "id, a, b, c",
    "(1, 'Índice', 'x', 'y'), (2, 'Capítulo 1 .... 3', 'Capítulo 2 .... 9', 'z'), (3, 'Capítulo 1', 'uno', 'dos'), (4, 'Prólogo | 3', 'Epílogo | 9', 'Afterword | 12'), (5, 'a', 'b', 'c'), (6, 'Prólogo', 'Capítulo uno', 'Epílogo 1 2 3'), (7, 'Capítulo a ..', 'Epílogo b ..', 'Afterword c')",
    ("100 + k", *(D.one_of(x, "'Capítulo ' || n || ' .... ' || k % 300", "'Prólogo | ' || n", "'Epílogo'", "'El índice'", "'uno'", "'dos 3 4'", "'texto ' || k") for x in (1, 2, 3))),
)
FLAT = Rows(
    "book_id, para_no, text",
    "('a', 0, 'una línea suelta'), ('a', 1, ''), ('a', 2, 'Prólogo'), ('a', 3, 'texto del prólogo'), ('a', 4, 'Capítulo 1: Lanzamiento'), ('a', 5, 'uno'), ('a', 6, ' dos '), ('a', 7, 'Epílogo'), ('b', 0, 'Capítulo 2'), ('b', 1, 'Parte 3'), ('b', 2, 'tres'), ('b', 3, CAST(NULL AS VARCHAR(9))), ('c', 0, 'solo'), ('c', 1, 'texto'), ('d', 0, '  '), ('e', 0, 'Índice'), ('e', 1, 'Short Story'), ('e', 2, 'fin')",
)
FLAGS = Rows(
    "book_id, page_idx, kind, is_toc, continues, is_empty",
    "('a', 0, CAST(NULL AS STRING), false, false, true), ('a', 1, NULL, true, false, false), ('a', 2, NULL, false, true, false), ('a', 3, NULL, false, false, true), ('a', 4, NULL, false, true, false), ('a', 5, 'part', false, false, false), ('a', 6, 'prologue', false, false, false), ('a', 7, NULL, false, false, false), ('a', 8, 'chapter', false, true, false), ('a', 9, 'epilogue', false, false, false), ('b', 0, NULL, true, true, false), ('b', 1, NULL, false, true, false), ('b', 2, NULL, false, false, true), ('b', 3, 'part', false, false, false), ('b', 4, 'afterword', false, false, false), ('c', 0, 'chapter', false, false, false), ('c', 1, NULL, true, true, false), ('c', 2, 'epilogue', false, false, false)",
    ("book", "n", f"CASE {D.pick(1, 14)} WHEN 0 THEN 'prologue' WHEN 1 THEN 'chapter' WHEN 2 THEN 'epilogue' WHEN 3 THEN 'part' WHEN 4 THEN 'afterword' END", f"{D.pick(2, 6)} = 0 AND {D.pick(4, 5)} <> 0", f"{D.pick(3, 2)} = 0 AND {D.pick(4, 5)} <> 0", f"{D.pick(4, 5)} = 0 AND {D.pick(1, 14)} > 4"),
)
RANGES = Rows(
    "book_id, ch_idx, start_idx, end_idx",
    "('b', 0, 0, 3), ('b', 0, 3, 5), ('b', 0, 7, 9), ('b', 1, 2, 4), ('b', 1, 3, 3), ('b', 2, 5, 9), ('b', 2, 1, 2)",
    ("book", D.inside(3), D.pick(1, 30), f"{D.pick(1, 30)} + {D.pick(2, 8)}"),
)
TOTALS = Rows(
    "book_id, ch_idx, total",
    "('b', 0, 12), ('b', 1, 4), ('b', 2, 9), ('b', 3, 6), ('b', 4, 0)",
    ("book", "n", D.pick(3, 40)),
    where="n < 3",
)
FRAGMENTS = Rows(
    "book_id, pos, ch_idx, start_idx, end_idx",
    "('b', 0, 0, 0, 5), ('b', 1, 0, 7, 9), ('b', 2, 0, 5, 7), ('b', 3, 0, 9, 12), ('b', 4, 1, 0, 0), ('b', 5, 1, 0, 4), ('b', 6, 1, 2, 6), ('b', 7, 0, 11, 14)",
    ("book", "n", D.inside(2), D.pick(1, 10), f"{D.pick(1, 10)} + {D.pick(2, 6)}"),
)
SPINE_PAGES = Rows(
    "book_id, page_idx, ch_idx, start_idx, end_idx, visual",
    "('b', 0, -1, CAST(NULL AS INT), CAST(NULL AS INT), true), ('b', 1, 0, 0, 3, false), ('b', 2, 0, NULL, NULL, false), ('b', 3, 0, 3, 5, false), ('b', 4, 0, NULL, NULL, true), ('b', 5, 0, 5, 6, false), ('b', 6, 1, 0, 2, false), ('b', 7, 1, 3, 4, false), ('b', 8, 1, 4, 9, false)",
    ("book", "n", D.block(4), f"CASE WHEN {D.pick(1, 4)} > 0 THEN n * 3 END", f"CASE WHEN {D.pick(1, 4)} > 0 THEN n * 3 + CASE {D.pick(2, 4)} WHEN 0 THEN 2 ELSE 3 END END", f"{D.pick(1, 4)} = 0 AND {D.pick(3, 2)} = 0"),
)
FRONT = Rows(
    "book_id, page_idx, n_images, ch_idx, width, height",
    "('b', 1, 1, -1, 800, 1200), ('b', 2, 1, -1, 800, 1200), ('b', 3, 1, -1, 800, 1200), ('b', 5, 1, -1, 100, 1200), ('b', 6, 1, -1, 900, 900), ('b', 7, 2, -1, 900, 900), ('b', 8, 1, 0, 900, 900), ('b', 9, 1, -1, 3000, 2000), ('b', 10, 1, -1, 10, 10), ('b', 11, 1, -1, 10, 11)",
    ("book", "n", f"1 + {D.pick(1, 6)} % 2 * {D.pick(1, 3)}", f"CASE {D.pick(2, 5)} WHEN 0 THEN 0 ELSE -1 END", f"200 + {D.pick(3, 2400)}", f"200 + {D.pick(4, 2000)}"),
)
COVERS = Rows(
    "book_id, page_idx, img_no, name, is_full_page, width, height, n_bytes",
    "('a', 3, 0, 'p3', true, 900, 1200, 90000), ('a', 0, 1, 'p0', false, 500, 500, 9000), ('b', 2, 0, 'x', false, 10, 10, 10), ('b', 1, 1, 'y', false, 20, 10, 10), ('c', 0, 0, 'u', false, 10, 10, 90), ('c', 4, 1, 'v', false, 700, 700, 90), ('d', 0, 0, 'm', true, 10, 10, 1), ('d', 0, 1, 'n', true, 10, 10, 1)",
    ("book", "n", "n", "'p' || k", f"{D.pick(1, 5)} = 0", D.pick(2, 900), D.pick(3, 900), D.pick(4, 20000)),
)
STATS = Rows(
    "id, width, height, avg_std, avg_mean, sat_mean, sat_std, gray_std, gray_entropy, color_count, rich_color_count, dominant_ratio, max_channel_range, visible_ratio, vis_std, sat_crop_mean, crop_entropy",
    "(1, 0, 9, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9, 9, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (2, 100, 100, 50.0, 9.0, 9.0, 9.0, 90.0, 9.0, 2, 9, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (3, 400, 400, 1.0, 9.0, 9.0, 9.0, 90.0, 0.5, 7, 9, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (4, 200, 200, 50.0, 9.0, 1.0, 1.0, 90.0, 9.0, 9, 100, 0.8, 90, 0.5, 50.0, 50.0, 5.0), (5, 500, 500, 50.0, 9.0, 9.0, 9.0, 90.0, 9.0, 1, 9, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (6, 210, 210, 7.0, 99.0, 9.0, 9.0, 90.0, 9.0, 9, 900, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (7, 400, 400, 4.0, 250.0, 90.0, 90.0, 90.0, 9.0, 9, 900, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (8, 500, 500, 40.0, 99.0, 90.0, 90.0, 90.0, 9.0, 9, 900, 0.1, 90, 0.5, 5.0, 5.0, 2.0), (9, 560, 560, 40.0, 99.0, 90.0, 90.0, 90.0, 9.0, 9, 900, 0.1, 30, 0.5, 9.0, 9.0, 2.5), (10, 900, 900, 40.0, 99.0, 90.0, 90.0, 90.0, 9.0, 9, 900, 0.1, 5, 0.95, 50.0, 50.0, 1.0), (11, 600, 600, 40.0, 99.0, 7.0, 5.0, 11.0, 2.0, 9, 900, 0.1, 90, 0.5, 50.0, 50.0, 5.0), (12, 900, 1200, 60.0, 120.0, 50.0, 40.0, 60.0, 7.0, 9, 4000, 0.1, 250, 0.99, 60.0, 50.0, 7.0)",
    ("100 + k", D.pick(1, 700), D.pick(2, 700), D.part(3, 30, 2), D.part(4, 255, 1), D.part(5, 24, 2), D.part(6, 24, 2), D.part(7, 40, 2), D.part(8, 12, 2), f"1 + {D.pick(9, 6)}", f"1 + {D.pick(10, 900)}", D.part(11, 10, 10), D.pick(12, 60), D.part(13, 20, 20), D.part(14, 40, 2), D.part(15, 40, 2), D.part(16, 16, 4)),
)
HISTOGRAMS = Rows(
    "id, h",
    "(1, array(1, 1)), (2, array(4, 0)), (3, array(1, 1, 1, 1)), (4, array(0, 0)), (5, array(3, 1, 4, 1, 5))",
    ("100 + k", f"array({', '.join(D.pick(x, 9) for x in range(5))})"),
)
IMAGES = Rows(
    "book_id, page_idx, img_no, name, is_full_page, caption",
    "('b', 4, 0, 'i1.jpg', false, 'uno'), ('b', 6, 1, 'i2.jpg', true, ''), ('b', 7, 2, 'i3.jpg', false, 'tres'), ('b', 1, 3, 'i4.jpg', true, ''), ('b', 30, 4, 'i5.jpg', true, ''), ('b', 12, 5, 'i6.jpg', true, 'seis'), ('b', 3, 6, 'i7.jpg', true, '')",
    ("book", "n", "n", "'i' || k || '.jpg'", f"{D.pick(6, 2)} = 0", D.one_of(7, "''", "'pie ' || k")),
    where=f"{D.pick(5, 3)} = 0",
)
PAGE_MAP = Rows(
    "book_id, page_idx, ch_idx",
    "('b', 1, -1), ('b', 3, 0), ('b', 4, 0), ('b', 5, 0), ('b', 6, 0), ('b', 7, 0), ('b', 9, 0), ('b', 12, 1), ('b', 13, 1), ('b', 30, 1)",
    ("book", "n", f"CASE WHEN n = 0 AND {D.pick(8, 2)} = 0 THEN -1 ELSE {D.block(5)} END"),
    where=f"{D.pick(9, 6)} > 0",
)
PAGE_RANGES = Rows(
    "book_id, ch_idx, page_idx, start_idx, end_idx",
    "('b', 0, 4, 0, 4), ('b', 0, 9, 4, 7), ('b', 1, 13, 0, 2)",
    ("book", D.block(5), "n", "n * 3", "n * 3 + 3"),
    where=f"n > 0 AND {D.pick(9, 6)} > 0 AND {D.pick(10, 2)} = 0",
)
ITEMS = Rows(
    "book_id, pos, type, ch_idx, start_idx, end_idx, first_text, imgs, hidden",
    "('b', 0, 'chapter_fragment', 0, 0, 5, 'hola', 'a,b', ''), ('b', 1, 'chapter_fragment', 0, 4, 9, 'hola', 'b,c', ''), ('b', 2, 'chapter_fragment', 0, 9, 12, 'más', 'c', 'c'), ('b', 3, 'img_page', -1, 0, 0, '', '', ''), ('b', 4, 'chapter_fragment', 0, 9, 12, 'más', 'c', ''), ('b', 5, 'chapter_fragment', 1, 0, 2, '', 'c', ''), ('b', 6, 'chapter_fragment', 1, 2, 3, '', '', '')",
    ("book", "n", f"CASE {D.pick(1, 5)} WHEN 0 THEN 'img_page' ELSE 'chapter_fragment' END", f"CASE {D.pick(1, 5)} WHEN 0 THEN -1 ELSE {D.block(4)} END", f"n * 3 - {D.pick(2, 2)}", "n * 3 + 3", D.one_of(3, "''", "'hola'", "'más'"), D.one_of(4, "''", "'a,b'", "'b,c'", "'c'"), D.one_of(5, "'b'", "''", "''")),
)
TEXTS = Rows(
    "book_id, ch_idx, pos, text",
    "('b', 0, 0, 'cero'), ('b', 0, 1, 'uno & *dos*'), ('b', 0, 2, 'tres'), ('b', 0, 5, 'cinco'), ('b', 0, 8, 'ocho'), ('b', 1, 0, 'a<b'), ('b', 1, 3, 'z')",
    ("book", D.block(6), D.inside(6), D.one_of(1, "'uno & *dos* ' || k", "'a<b> **c** ' || priority", "'tres ' || k", "'—' || priority")),
)


def page_heading(spark, sf_dir):
    h = PARAS.frame(spark, sf_dir).select("id", T.page_heading(F.filter(F.array("a", "b"), lambda x: x != "")).alias("h"))
    return h.where("h is not null").select("id", "h.kind", "h.title", "h.subtitle", "h.consume")


def _kind_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {D.fits(x, p)} THEN '{k}'" for k, p in P.SPECIAL) + " END"


def _heads_sql(x: str) -> str:
    return f"({_kind_sql(x)} IS NOT NULL OR {D.fits(x, P.CHAPTER)} OR {D.fits(x, P.PART)} OR {D.fits(x, P.SHORT_STORY)})"


def _candidates_sql(source: str) -> str:
    """The heading of rows (id, c): c holds heading texts, none of them empty; rows without a heading are left out."""
    return f"""WITH w AS (SELECT id, c, coalesce(list_position(list_transform(c[:4], lambda x: {_heads_sql('x')}), true), 1) AS k FROM {source}),
  e AS (SELECT id, k, c[k] AS f, coalesce(c[k + 1], '') AS r FROM w),
  g AS (SELECT *, length(f) <= 120 AND {D.count('f', '[.]')} < 3 AS short, {_kind_sql('r')} AS next_special, {D.subtitle('r')} AND {D.toc_score('r')} < 2 AS usable, {D.fits('r', P.CHAPTER)} AS next_chapter,
    regexp_extract(f, {D.q('(?i)' + P.CHAPTER)}, 2) AS label, regexp_extract(f, {D.q('(?i)' + P.CHAPTER)}, 4) AS own,
    regexp_extract(f, {D.q('(?i)' + P.PART)}, 2) AS part_label, regexp_extract(f, {D.q('(?i)' + P.PART)}, 4) AS part_own FROM e WHERE f <> ''),
  d AS (SELECT *, CASE WHEN short THEN {_kind_sql('f')} END AS special, short AND {D.fits('f', P.CHAPTER)} AS is_chapter, short AND {D.fits('f', P.PART)} AS is_part FROM g),
  h AS (SELECT *, CASE WHEN special IS NOT NULL THEN special WHEN is_chapter THEN 'chapter' WHEN is_part THEN 'part' WHEN short AND {D.fits('f', P.NUMBERED, False)} THEN 'chapter' END AS kind FROM d),
  t AS (SELECT *, CASE WHEN special IS NOT NULL THEN '' WHEN is_chapter THEN own WHEN is_part THEN part_own WHEN kind = 'chapter' THEN regexp_extract(f, {D.q(P.NUMBERED)}, 2) ELSE '' END AS mine,
    CASE WHEN special = 'afterword' AND lower(r) = 'palabras del autor' THEN usable WHEN special IS NOT NULL OR is_chapter THEN usable AND next_special IS NULL AND NOT next_chapter WHEN is_part THEN usable ELSE false END AS takes FROM h WHERE kind IS NOT NULL)
  SELECT id, kind, CASE WHEN special = 'prologue' THEN 'Prólogo' WHEN special = 'epilogue' THEN 'Epílogo' WHEN special = 'afterword' THEN CASE WHEN prefix(lower(f), 'afterword') THEN 'Afterword' ELSE 'Palabras del autor' END
    WHEN special = 'acknowledgements' THEN CASE WHEN prefix(lower(f), 'agradecimiento') THEN 'Agradecimiento' ELSE 'Agradecimientos' END WHEN special = 'short_story' THEN 'Short Story'
    WHEN special = 'part' THEN 'Parte ' || regexp_extract(f, '(?i)([0-9]+|[ivxlcdm]+)', 1) WHEN special IS NOT NULL THEN f
    WHEN is_chapter THEN 'Capítulo ' || CASE WHEN regexp_matches(label, '^\\p{{L}}+$') THEN upper(label[1]) || lower(label[2:]) ELSE label END
    WHEN is_part THEN 'Parte ' || part_label ELSE 'Capítulo ' || regexp_extract(f, {D.q(P.NUMBERED)}, 1) END AS title,
    CASE WHEN takes AND mine = '' THEN r ELSE mine END AS subtitle, CAST(k + CASE WHEN takes AND mine = '' THEN 1 ELSE 0 END AS INT) AS consume FROM t"""


def _headings_sql(texts: str) -> str:
    return f"list_filter(list_transform({texts}, lambda x: {D.heading('x')}), lambda x: x <> '')"


def _contents_sql(c: str) -> str:
    """Whether a list of paragraphs in a column is a contents page."""
    j = D.heading(f"array_to_string({c}, ' ')")
    scores = f"list_transform(list_transform({c}, lambda x: {D.heading('x')}), lambda x: {D.toc_score('x')})"
    numbers = f"len(list_filter(string_split_regex({j}, {D.q(f'[^{P.WORD}]+')}), lambda x: regexp_matches(x, '^[0-9]{{1,4}}$')))"
    mentions, dots = D.count(f"lower({j})", P.TOC_MENTIONS), D.count(j, "[.]{2,}")
    return f"""(len({c}) > 0 AND ({D.fits(f'lower({j})', P.TOC_KEYWORDS, False)} OR len(list_filter({scores}, lambda x: x >= 3)) >= 2
      OR (len(list_filter({scores}, lambda x: x >= 2)) >= 3 AND {numbers} >= 3) OR ({mentions} >= 3 AND ({numbers} >= 3 OR {dots} >= 2))))"""


_HEADING_SQL = lambda rows: _candidates_sql(f"(SELECT id, {_headings_sql('[a, b]')} AS c FROM {rows})")


def toc_pages(spark, sf_dir):
    return TOC_PAGES.frame(spark, sf_dir).select("id", T.is_toc_page(F.array("a", "b", "c")).alias("is_toc"))


_TOC_SCORES = "[" + ", ".join(D.toc_score(f"h{x}") for x in "abc") + "]"
TOC_SQL = f"""SELECT id, {D.fits('lower(j)', P.TOC_KEYWORDS, False)} OR len(list_filter(s, lambda x: x >= 3)) >= 2 OR (len(list_filter(s, lambda x: x >= 2)) >= 3 AND nums >= 3)
  OR (mentions >= 3 AND (nums >= 3 OR dots >= 2)) AS is_toc FROM (SELECT id, j, {_TOC_SCORES} AS s, {D.count('lower(j)', P.TOC_MENTIONS)} AS mentions, {D.count('j', '[.]{2,}')} AS dots,
  len(list_filter(string_split_regex(j, {D.q(f'[^{P.WORD}]+')}), lambda x: regexp_matches(x, '^[0-9]{{1,4}}$'))) AS nums
  FROM (SELECT id, {D.heading("a || ' ' || b || ' ' || c")} AS j, {D.heading('a')} AS ha, {D.heading('b')} AS hb, {D.heading('c')} AS hc FROM {TOC_PAGES.sql}))"""

_FLAGS_SQL = FLAGS.sql.replace("AS STRING", "AS VARCHAR")


def toc_scan(spark, sf_dir):
    return S.mark_pages(FLAGS.frame(spark, sf_dir)).select("book_id", "page_idx", "toc", "first_body", "auxiliary", "front_matter")


def _mark_sql(flags: str) -> str:
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, coalesce(min(page_idx) FILTER (kind IN ('prologue', 'chapter')) OVER (PARTITION BY book_id), -1) AS early, max(page_idx) OVER (PARTITION BY book_id) + 1 AS n FROM {flags}),
  scan AS (SELECT book_id, -1 AS page_idx, false AS mode, false AS toc FROM (SELECT DISTINCT book_id FROM p)
    UNION ALL SELECT p.book_id, p.page_idx, inside AND (is_toc OR (mode AND continues)), inside AND (is_toc OR (mode AND continues))
    FROM scan s JOIN (SELECT *, page_idx < CASE WHEN early > 0 THEN early ELSE least(n, 40) END AS inside FROM p) p ON p.book_id = s.book_id AND p.page_idx = s.page_idx + 1),
  b AS (SELECT p.*, s.toc FROM p JOIN scan s USING (book_id, page_idx)),
  f AS (SELECT *, CASE WHEN early >= 0 THEN early ELSE coalesce((SELECT min(x.page_idx) FROM b x WHERE x.book_id = b.book_id AND NOT x.toc AND x.kind IS NOT NULL), -1) END AS first_body FROM b),
  a AS (SELECT *, toc OR (is_empty AND page_idx < first_body AND EXISTS (SELECT 1 FROM f y WHERE y.book_id = f.book_id AND y.toc AND abs(y.page_idx - f.page_idx) <= 1)) AS auxiliary FROM f)"""

MARK_SQL = _mark_sql(_FLAGS_SQL)
TOC_SCAN_SQL = MARK_SQL + " SELECT book_id, page_idx, toc, first_body, auxiliary, page_idx < first_body AND NOT auxiliary AS front_matter FROM a"


def sections_pages(spark, sf_dir):
    x = S.fold(S.mark_pages(FLAGS.frame(spark, sf_dir)), F.col("page_idx") != 5)
    return x.select("book_id", "page_idx", "starts", F.coalesce("ch_idx", F.lit(-1)).alias("ch_idx"))


SECTIONS_SQL = MARK_SQL + """, u AS (SELECT *, NOT auxiliary AND NOT is_empty AS usable FROM a),
  h AS (SELECT *, usable AND kind IS NOT NULL AND (kind NOT IN ('epilogue', 'afterword', 'acknowledgements') OR EXISTS (SELECT 1 FROM u y WHERE y.book_id = u.book_id AND y.usable AND y.kind IN ('prologue', 'chapter') AND y.page_idx < u.page_idx)) AS starts FROM u),
  i AS (SELECT book_id, min(page_idx) AS page_idx FROM h WHERE usable AND page_idx <> 5 AND NOT EXISTS (SELECT 1 FROM h y WHERE y.book_id = h.book_id AND y.starts AND y.page_idx <= h.page_idx) GROUP BY book_id),
  s AS (SELECT book_id, page_idx, row_number() OVER (PARTITION BY book_id ORDER BY page_idx) - 1 AS ch FROM (SELECT book_id, page_idx FROM h WHERE starts UNION SELECT book_id, page_idx FROM i))
  SELECT h.book_id, h.page_idx, starts, CAST(CASE WHEN auxiliary THEN -1 ELSE coalesce((SELECT max(ch) FROM s WHERE s.book_id = h.book_id AND s.page_idx <= h.page_idx), -1) END AS BIGINT) AS ch_idx FROM h"""


#: Headings and contents that stand before the text of every twelfth page, in words that both engines read.
_HEADED = """CASE page_idx % 12 WHEN 1 THEN 'Índice' || chr(10) || 'Capítulo 1 .... 3' || chr(10) WHEN 2 THEN 'Capítulo 2 .... 9' || chr(10) || 'Capítulo 3 .... 12' || chr(10)
  WHEN 4 THEN 'Prólogo' || chr(10) WHEN 6 THEN 'Capítulo ' || page_idx || ': Una Salida' || chr(10) WHEN 8 THEN 'Parte ' || page_idx || chr(10) || 'El Camino Largo' || chr(10) WHEN 10 THEN 'Epílogo' || chr(10) ELSE '' END || raw_text"""


def document_sections(spark, sf_dir):
    """The whole fold over the documents as books, headings and contents before some pages: sections with their sizes."""
    pages = book_pages(table(spark, sf_dir, "documents")).select("book_id", "page_idx", F.expr(_HEADED).alias("raw_text"))
    told, text, _ = S.sections(S.page_paragraphs(pages, L.paragraphs(L.page_lines(pages))))
    n = text.groupBy("book_id", "ch_idx").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))
    x = told.join(n, ["book_id", "ch_idx"], "left")
    return x.select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), "title", "subtitle", "section_kind", "is_intro", "first_page_idx", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


_HEADED_PAGES = f"(SELECT book_id, page_idx, {_HEADED} AS raw_text FROM {D.PAGES})"
_DESCRIBED = f"""(WITH t AS MATERIALIZED ({fold_sql(f"({lines_sql(_HEADED_PAGES)})")}),
    g AS MATERIALIZED (SELECT w.book_id, w.page_idx, coalesce(p.paras, []) AS paras FROM {D.PAGES} w LEFT JOIN (SELECT book_id, page_idx, list(text ORDER BY para_no) AS paras FROM t WHERE text <> '' GROUP BY ALL) p USING (book_id, page_idx)),
    c AS MATERIALIZED (SELECT book_id || ':' || page_idx AS id, {_headings_sql('paras[:5]')} AS c FROM g),
    h AS MATERIALIZED ({_candidates_sql(f"(SELECT * FROM c WHERE len(c) > 0 AND NOT ({D.toc_score('c[1]')} >= 3 AND {_contents_sql('c')}))")})
  SELECT book_id, page_idx, paras, kind, title, subtitle, consume, {_contents_sql('paras')} AS is_toc,
    coalesce(list_sum(list_transform(list_transform(paras[:6], lambda x: {D.heading('x')}), lambda x: {D.toc_score('x')})), 0) >= 5 AS continues, len(paras) = 0 AS is_empty
  FROM g LEFT JOIN h ON h.id = book_id || ':' || page_idx)"""
_KEPT = "paras[(CASE WHEN starts THEN consume ELSE 0 END) + 1:]"
DOCUMENT_SECTIONS_SQL = _mark_sql(_DESCRIBED) + f""", u AS (SELECT *, NOT auxiliary AND NOT is_empty AS usable FROM a),
  h AS (SELECT *, usable AND kind IS NOT NULL AND (kind NOT IN ('epilogue', 'afterword', 'acknowledgements') OR EXISTS (SELECT 1 FROM u y WHERE y.book_id = u.book_id AND y.usable AND y.kind IN ('prologue', 'chapter') AND y.page_idx < u.page_idx)) AS starts FROM u),
  j AS (SELECT *, array_to_string({_KEPT}, ' ') AS text FROM h),
  k AS MATERIALIZED (SELECT *, CASE WHEN auxiliary OR (len({_KEPT}) <= 2 AND {separator_sql('text')}) THEN [] ELSE {_KEPT} END AS kept FROM j),
  i AS (SELECT book_id, min(page_idx) AS page_idx FROM k WHERE usable AND len(kept) > 0 AND NOT EXISTS (SELECT 1 FROM k y WHERE y.book_id = k.book_id AND y.starts AND y.page_idx <= k.page_idx) GROUP BY book_id),
  s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_idx) - 1 AS ch FROM (SELECT book_id, page_idx, title, subtitle, kind FROM k WHERE starts UNION ALL SELECT book_id, page_idx, 'Introducción', '', 'intro' FROM i)),
  n AS (SELECT book_id, ch, CAST(sum(len(kept)) AS BIGINT) AS n, CAST(sum(length(array_to_string(kept, ''))) AS BIGINT) AS chars FROM (SELECT k.book_id, kept, (SELECT max(ch) FROM s WHERE s.book_id = k.book_id AND s.page_idx <= k.page_idx) AS ch FROM k WHERE NOT auxiliary) GROUP BY book_id, ch)
  SELECT s.book_id, ch AS ch_idx, title, subtitle, kind AS section_kind, kind <> 'chapter' AS is_intro, page_idx AS first_page_idx, coalesce(n, 0) AS n_paragraphs, coalesce(chars, 0) AS n_chars FROM s LEFT JOIN n USING (book_id, ch)"""


def sections_paragraphs(spark, sf_dir):
    """Sections of texts without pages, with their sizes: made-up books, and conversations with a paragraph a turn."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("para_no"), "text")
    told, text = S.paragraph_sections(FLAT.frame(spark, sf_dir).unionByName(turns))
    n = text.groupBy("book_id", "ch_idx").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))
    x = told.join(n, ["book_id", "ch_idx"], "left")
    return x.select("book_id", "ch_idx", "title", "subtitle", "section_kind", "is_intro", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


FLAT_SQL = f"""WITH p AS (SELECT book_id || ':' || para_no AS id, * FROM (SELECT book_id, para_no, {D.strip('text')} AS text FROM (SELECT * FROM {FLAT.sql} UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, text FROM conversations)) WHERE text <> ''),
  g AS (SELECT *, {D.heading('text')} AS h FROM p),
  ok AS (SELECT * FROM g WHERE NOT ({D.toc_score('h')} >= 3 AND ({D.fits('lower(h)', P.TOC_KEYWORDS, False)} OR ({D.count('lower(h)', P.TOC_MENTIONS)} >= 3 AND {D.count('h', '[.]{2,}')} >= 2)))),
  s AS ({_HEADING_SQL("(SELECT id, text AS a, '' AS b FROM ok)")}),
  k AS (SELECT p.*, s.kind, s.title, s.subtitle FROM p LEFT JOIN (SELECT s.* FROM s JOIN g USING (id) WHERE kind = 'short_story' OR (length(h) <= 120 AND {D.count('h', '[.]')} < 3)) s USING (id)),
  n AS (SELECT *, count(kind) OVER (PARTITION BY book_id ORDER BY para_no ROWS UNBOUNDED PRECEDING) AS seq FROM k),
  c AS (SELECT *, seq - CASE WHEN min(seq) OVER (PARTITION BY book_id) = 0 THEN 0 ELSE 1 END AS ch FROM n)
  SELECT book_id, CAST(ch AS INT) AS ch_idx, coalesce(max(title), 'Introducción') AS title, coalesce(max(subtitle), '') AS subtitle, coalesce(max(kind), 'intro') AS section_kind, coalesce(max(kind), '') <> 'chapter' AS is_intro,
    count(*) FILTER (kind IS NULL) AS n_paragraphs, CAST(coalesce(sum(length(text)) FILTER (kind IS NULL), 0) AS BIGINT) AS n_chars FROM c GROUP BY book_id, ch"""


def page_to_section(spark, sf_dir):
    """A conversation is a book, its turns are pages, user turns start sections, system turns are auxiliary."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("page_idx"), (F.col("role") == "system").alias("auxiliary"), "role")
    starts = pages.where("role = 'user'").select("book_id", F.col("page_idx").alias("first_page_idx"), F.expr("cast(row_number() over (partition by book_id order by page_idx) - 1 as int)").alias("ch_idx"))
    return S.page_to_section(pages.drop("role"), starts)


ASOF_SQL = """WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, turn AS page_idx, role FROM conversations),
  s AS (SELECT book_id, page_idx, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_idx) - 1 AS INT) AS ch FROM p WHERE role = 'user')
  SELECT p.book_id, p.page_idx, CASE WHEN role = 'system' THEN -1 ELSE coalesce(ch, -1) END AS ch_idx FROM p ASOF LEFT JOIN s ON p.book_id = s.book_id AND p.page_idx >= s.page_idx"""


def decorative_filter(spark, sf_dir):
    """A source is a book, a document a page with one picture: its text's hash, and sides by its length."""
    d = table(spark, sf_dir, "documents")
    pages = d.groupBy(F.col("source").alias("book_id")).agg(F.count("*").cast("int").alias("n_pages"))
    x = d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_idx"), F.lit(0).alias("img_no"), F.sha1("text").alias("sha1"), F.length("text").alias("width"), (F.length("text") % 700).alias("height"))
    return I.decorative(x.join(pages, "book_id")).select("book_id", "page_idx", "sha1", "repeats", "is_decorative")


DECOR_SQL = """WITH x AS (SELECT source AS book_id, doc_id AS page_idx, sha1(text) AS sha1, coalesce(length(text), 0) AS w, coalesce(length(text) % 700, 0) AS h, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL)
  SELECT book_id, page_idx, sha1, repeats, repeats >= greatest(5, n // 10) AND (w * h <= 120000 OR greatest(w, h) <= 600) AS is_decorative
  FROM (SELECT *, count(*) OVER (PARTITION BY book_id, sha1) AS repeats FROM x WHERE sha1 IS NOT NULL)"""


def decorative_pages(spark, sf_dir):
    x = decorative_filter(spark, sf_dir).where("repeats >= 2")
    return x.groupBy("book_id", "sha1").agg(F.array_join(F.array_sort(F.collect_set("page_idx")), ",").alias("pages"))


def image_artifact_rules(spark, sf_dir):
    return STATS.frame(spark, sf_dir).select("id", I.artifact_rule().alias("rule"))


ARTIFACT_SQL = f"""SELECT id, CASE WHEN area <= 0 THEN 0
    WHEN color_count <= 2 AND area <= 120000 THEN 1 WHEN color_count <= 2 AND avg_std < 3.0 AND gray_entropy < 1.2 THEN 1
    WHEN avg_std < 2.0 AND gray_entropy < 0.8 AND area <= 180000 THEN 2
    WHEN area <= 50000 AND side <= 240 AND sat_mean < 1.5 AND sat_std < 1.5 AND rich_color_count <= 160 AND dominant_ratio >= 0.7 THEN 3
    WHEN color_count = 1 AND area <= 250000 THEN 4
    WHEN area <= 50000 AND avg_std < 6.0 THEN 5 WHEN side <= 220 AND avg_std < 8.0 THEN 5
    WHEN area <= 180000 AND avg_std < 5.0 AND avg_mean NOT BETWEEN 15 AND 245 THEN 6
    WHEN vis_std < 6.0 AND sat_crop_mean < 8.0 AND crop_entropy < 2.2 AND area <= 250000 THEN 8
    WHEN vis_std < 10.0 AND sat_crop_mean < 10.0 AND crop_entropy < 2.6 AND area <= 320000 AND max_channel_range <= 40 THEN 9
    WHEN max_channel_range <= 6 AND visible_ratio > 0.9 AND crop_entropy < 2.0 THEN 11
    WHEN area <= 400000 AND sat_mean < 8.0 AND sat_std < 6.0 AND gray_std < 12.0 AND gray_entropy < 3.0 AND avg_mean < 200 THEN 12 END AS rule
  FROM (SELECT *, width * height AS area, greatest(width, height) AS side FROM {STATS.sql})"""


def pixel_stats(spark, sf_dir):
    """A document is a picture four pixels wide: its bytes, zeros behind them, as red, green, blue and alpha."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b"))
    d = d.withColumn("height", F.ceil(F.length("b") / 16).cast("int"))
    pictures = d.select("id", F.lit(4).alias("width"), "height", F.concat("b", F.unhex(F.repeat(F.lit("00"), 16 * F.col("height") - F.length("b")))).alias("pixels"))
    x = pixel_statistics(pictures)
    return x.select("id", "height", "color_count", "rich_color_count", "max_channel_range", *(F.round(c, 4).alias(c) for c in ("avg_mean", "avg_std", "gray_std", "gray_entropy", "sat_mean", "visible_ratio")))


PIXEL_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(ceil(strlen(coalesce(text, '')) / 16) AS BIGINT) AS height FROM documents),
  f AS (SELECT doc_id, height, h || repeat('00', CAST(16 * height - length(h) // 2 AS INT)) AS h FROM d),
  x AS (SELECT doc_id, height, i, substr(h, 8 * i + 1, 8) AS c FROM (SELECT *, unnest(range(4 * height)) AS i FROM f)),
  v AS (SELECT *, CAST('0x' || c[1:2] AS INT) AS r, CAST('0x' || c[3:4] AS INT) AS g, CAST('0x' || c[5:6] AS INT) AS b, c[7:8] <> '00' AS seen FROM x),
  w AS (SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS gray, 255 * (greatest(r, g, b) - least(r, g, b)) // greatest(r, g, b, 1) AS s FROM v),
  e AS (SELECT doc_id, -sum(n / t * log2(n / t)) + 0 AS bits FROM (SELECT doc_id, gray, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM w GROUP BY doc_id, gray) GROUP BY doc_id),
  box AS (SELECT doc_id, min(i // 4) AS y0, max(i // 4) AS y1, min(i % 4) AS x0, max(i % 4) AS x1 FROM w WHERE seen GROUP BY doc_id),
  inside AS (SELECT doc_id, any_value((y1 - y0 + 1) * (x1 - x0 + 1)) AS n, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) AS reach FROM w JOIN box USING (doc_id) WHERE i // 4 BETWEEN y0 AND y1 AND i % 4 BETWEEN x0 AND x1 GROUP BY doc_id),
  a AS (SELECT doc_id, count(DISTINCT c) AS colors, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, stddev_pop(r) AS sr, stddev_pop(g) AS sg, stddev_pop(b) AS sb, stddev_pop(gray) AS sy, avg(s) AS ms FROM w GROUP BY doc_id)
  SELECT f.doc_id AS id, f.height, CASE WHEN colors <= 8 THEN colors END AS color_count, CASE WHEN 4 * f.height <= 50000 THEN colors END AS rich_color_count, CAST(reach AS BIGINT) AS max_channel_range,
    round((mr + mg + mb) / 3, 4) AS avg_mean, round((sr + sg + sb) / 3, 4) AS avg_std, round(sy, 4) AS gray_std, round(bits, 4) AS gray_entropy, round(ms, 4) AS sat_mean, round(inside.n / (4.0 * f.height), 4) AS visible_ratio
  FROM f LEFT JOIN a ON a.doc_id = f.doc_id LEFT JOIN e ON e.doc_id = f.doc_id LEFT JOIN inside ON inside.doc_id = f.doc_id"""


def histogram_entropy(spark, sf_dir):
    return HISTOGRAMS.frame(spark, sf_dir).select("id", F.round(I.entropy(F.transform("h", lambda c: c.cast("double"))), 6).alias("entropy"))


ENTROPY_SQL = f"SELECT id, round(coalesce(-sum(c / t * log2(c / t)) FILTER (c > 0) + 0, 0), 6) AS entropy FROM (SELECT id, unnest(h) AS c, CAST(list_sum(h) AS DOUBLE) AS t FROM {HISTOGRAMS.sql.replace('array(', 'list_value(')}) GROUP BY id"


def cover_pick(spark, sf_dir):
    return I.pick_cover(COVERS.frame(spark, sf_dir))


COVER_SQL = f"""SELECT book_id, page_idx, img_no, name FROM {COVERS.sql} QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY NOT (is_full_page OR width * height >= 160000 OR n_bytes >= 12000), page_idx <> 0, NOT is_full_page, page_idx, -width * height, img_no) = 1"""


def cover_resolve(spark, sf_dir):
    x = I.pick_cover(COVERS.frame(spark, sf_dir))
    manual = F.when(F.col("book_id") == "a", "own.jpg").otherwise("")
    return x.select("book_id", I.resolve_cover(manual, F.col("name")).alias("cover"))


def page_ranges(spark, sf_dir):
    return S.page_ranges(TEXTS.frame(spark, sf_dir).withColumn("page_idx", F.floor(F.col("pos") / 3).cast("int")))


def neighbor_text_page(spark, sf_dir):
    x = PAGE_MAP.frame(spark, sf_dir).where("ch_idx >= 0").join(PAGE_RANGES.frame(spark, sf_dir).select("book_id", "ch_idx", "page_idx", F.lit(True).alias("t")), ["book_id", "ch_idx", "page_idx"], "left")
    return I.neighbour_pages(x.withColumn("has_text", F.coalesce("t", F.lit(False)))).select("book_id", "ch_idx", "page_idx", "before", "after")


_NEAR = f"""(SELECT m.book_id, m.ch_idx, m.page_idx, (SELECT max(r.page_idx) FROM {PAGE_RANGES.sql} r WHERE r.book_id = m.book_id AND r.ch_idx = m.ch_idx AND r.page_idx BETWEEN m.page_idx - 2 AND m.page_idx - 1) AS before,
  (SELECT min(r.page_idx) FROM {PAGE_RANGES.sql} r WHERE r.book_id = m.book_id AND r.ch_idx = m.ch_idx AND r.page_idx BETWEEN m.page_idx + 1 AND m.page_idx + 2) AS after FROM {PAGE_MAP.sql} m WHERE ch_idx >= 0)"""


def image_anchors(spark, sf_dir):
    return I.anchor_images(IMAGES.frame(spark, sf_dir), PAGE_MAP.frame(spark, sf_dir), PAGE_RANGES.frame(spark, sf_dir))


ANCHOR_SQL = f"""SELECT i.book_id, n.ch_idx, CASE WHEN is_full_page THEN coalesce(p.end_idx, 0) - 1 ELSE coalesce(o.end_idx, 0) - 1 END AS after_para_idx, name AS imgname, caption, CASE WHEN is_full_page THEN 'fullblock' ELSE 'inline' END AS layout, i.page_idx
  FROM {IMAGES.sql} i JOIN {_NEAR} n ON n.book_id = i.book_id AND n.page_idx = i.page_idx LEFT JOIN {PAGE_RANGES.sql} o ON o.book_id = i.book_id AND o.ch_idx = n.ch_idx AND o.page_idx = i.page_idx
  LEFT JOIN {PAGE_RANGES.sql} p ON p.book_id = i.book_id AND p.ch_idx = n.ch_idx AND p.page_idx = n.before WHERE NOT is_full_page OR n.before IS NOT NULL OR n.after IS NOT NULL"""


def spine_segments(spark, sf_dir):
    return Z.segments(SPINE_PAGES.frame(spark, sf_dir))


SEGMENT_SQL = f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_idx) AS rn FROM {SPINE_PAGES.sql} WHERE start_idx IS NOT NULL OR visual),
  f AS (SELECT book_id, rn, ch_idx, start_idx, end_idx, CASE WHEN start_idx IS NULL THEN 0 ELSE 1 END AS seg, page_idx FROM k WHERE rn = 1
    UNION ALL SELECT k.book_id, k.rn, k.ch_idx, k.start_idx, k.end_idx, f.seg + CASE WHEN k.start_idx IS NULL OR (f.end_idx IS NOT NULL AND f.ch_idx = k.ch_idx AND f.end_idx = k.start_idx) THEN 0 ELSE 1 END, k.page_idx FROM f JOIN k ON k.book_id = f.book_id AND k.rn = f.rn + 1),
  g AS (SELECT book_id, seg, any_value(ch_idx) AS ch_idx, min(start_idx) AS start_idx, max(end_idx) AS end_idx, min(page_idx) AS first_page FROM f WHERE start_idx IS NOT NULL GROUP BY book_id, seg)
  SELECT book_id, ch_idx, start_idx, end_idx, first_page, first_page = min(first_page) OVER (PARTITION BY book_id, ch_idx) AS include_header FROM g"""


def front_visual_pairs(spark, sf_dir):
    return I.pair_front_pages(FRONT.frame(spark, sf_dir))


FRONT_SQL = f"""WITH RECURSIVE c AS (SELECT book_id, page_idx FROM {FRONT.sql} WHERE n_images = 1 AND ch_idx < 0 AND greatest(width, height) / greatest(1, least(width, height)) <= 1.9 AND width * height <= 3000000),
  f AS (SELECT book_id, page_idx, page_idx AS pair FROM c WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.book_id = c.book_id AND y.page_idx = c.page_idx - 1)
    UNION ALL SELECT c.book_id, c.page_idx, CASE WHEN f.pair = f.page_idx THEN f.pair ELSE c.page_idx END FROM f JOIN c ON c.book_id = f.book_id AND c.page_idx = f.page_idx + 1)
  SELECT book_id, page_idx, pair, count(*) OVER (PARTITION BY book_id, pair) AS images FROM f"""


def interval_merge(spark, sf_dir):
    return Z.merge_intervals(RANGES.frame(spark, sf_dir))


_MERGED = lambda source, key: f"""(SELECT {key}, start_idx, max(reach) AS end_idx FROM (SELECT {key}, s AS start_idx, e AS reach FROM (
  WITH RECURSIVE r AS (SELECT {key}, start_idx AS s, end_idx AS e FROM {source} UNION SELECT x.{key.replace(', ', ', x.')}, x.s, y.end_idx FROM r x JOIN {source} y ON {' AND '.join(f'y.{k} = x.{k}' for k in key.split(', '))} AND y.start_idx >= x.s AND y.start_idx <= x.e)
  SELECT * FROM r)) q WHERE NOT EXISTS (SELECT 1 FROM {source} z WHERE {' AND '.join(f'z.{k} = q.{k}' for k in key.split(', '))} AND z.start_idx < q.start_idx AND z.end_idx >= q.start_idx) GROUP BY {key}, start_idx)"""  # noqa: E731


def order_intervals(spark, sf_dir):
    """Spans of 40 days after each order, merged for each customer."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    spans = o.select("o_custkey", day.alias("start_idx"), (day + 40).alias("end_idx"))
    # Orders without a date touch no other, nor each other.
    return Z.merge_intervals(spans.where("start_idx is not null"), ("o_custkey",)).unionByName(spans.where("start_idx is null"))


ORDER_SQL = """WITH o AS (SELECT o_custkey, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS s FROM orders),
  m AS (SELECT *, max(s + 40) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
  g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT o_custkey, min(s) AS start_idx, max(s) + 40 AS end_idx FROM g GROUP BY o_custkey, k"""


def interval_gaps(spark, sf_dir):
    return Z.gaps(RANGES.frame(spark, sf_dir), TOTALS.frame(spark, sf_dir))


GAPS_SQL = f"""WITH u AS (SELECT book_id, ch_idx, i FROM (SELECT *, unnest(range(0, total)) AS i FROM {TOTALS.sql}) t WHERE NOT EXISTS (SELECT 1 FROM {RANGES.sql} r WHERE r.book_id = t.book_id AND r.ch_idx = t.ch_idx AND t.i >= r.start_idx AND t.i < r.end_idx))
  SELECT book_id, ch_idx, CAST(min(i) AS INT) AS start_idx, CAST(max(i) + 1 AS INT) AS end_idx FROM (SELECT *, i - row_number() OVER (PARTITION BY book_id, ch_idx ORDER BY i) AS k FROM u) GROUP BY book_id, ch_idx, k"""


def fragment_normalize(spark, sf_dir):
    return Z.normalize_fragments(FRAGMENTS.frame(spark, sf_dir))


NORMALIZE_SQL = f"""SELECT book_id, pos, ch_idx, s AS start_idx, end_idx, end_idx > s AS is_kept, CASE WHEN end_idx <= s THEN 'empty_drop' WHEN s > start_idx THEN 'overlap_trim' END AS issue
  FROM (SELECT *, greatest(start_idx, coalesce((SELECT max(y.end_idx) FROM {FRAGMENTS.sql} y WHERE y.book_id = f.book_id AND y.ch_idx = f.ch_idx AND y.pos < f.pos AND y.end_idx > y.start_idx), start_idx)) AS s FROM {FRAGMENTS.sql} f)"""


def _items(spark, sf_dir):
    return ITEMS.frame(spark, sf_dir).withColumn("images", F.filter(F.split("imgs", ","), lambda x: x != "")).withColumn("suppress_images", F.filter(F.split("hidden", ","), lambda x: x != ""))


def fragment_validate(spark, sf_dir):
    return Z.validate_fragments(_items(spark, sf_dir))


_ITEMS_SQL = f"(SELECT book_id, pos, type, ch_idx, start_idx, end_idx, first_text, list_filter(string_split(imgs, ','), lambda x: x <> '') AS images, list_filter(string_split(hidden, ','), lambda x: x <> '') AS hide FROM {ITEMS.sql})"
VALIDATE_SQL = f"""WITH p AS (SELECT b.book_id, b.pos, b.ch_idx, b.start_idx < a.end_idx AS o, b.first_text = a.first_text AND b.first_text <> '' AS s, list_sort(list_filter(list_intersect(a.images, b.images), lambda x: NOT list_contains(b.hide, x))) AS i
    FROM {_ITEMS_SQL} a JOIN {_ITEMS_SQL} b ON b.book_id = a.book_id AND b.pos = a.pos + 1 AND a.ch_idx = b.ch_idx AND a.type = 'chapter_fragment' AND b.type = 'chapter_fragment')
  SELECT book_id, pos, ch_idx, 'overlap' AS issue FROM p WHERE o UNION ALL SELECT book_id, pos, ch_idx, 'same_start_text' FROM p WHERE s UNION ALL SELECT book_id, pos, ch_idx, 'shared_images:' || array_to_string(i, ',') FROM p WHERE len(i) > 0"""


def fragment_suppress(spark, sf_dir):
    return Z.suppress_shared(_items(spark, sf_dir).where("type = 'chapter_fragment'")).select("book_id", "pos", F.array_join("suppress_images", ",").alias("hidden"))


SUPPRESS_SQL = f"SELECT book_id, pos, array_to_string(list_sort(coalesce(list_intersect(lag(images) OVER (PARTITION BY book_id, ch_idx ORDER BY pos), images), [])), ',') AS hidden FROM {_ITEMS_SQL} WHERE type = 'chapter_fragment'"


def fragment_first_text(spark, sf_dir):
    return Z.first_texts(FRAGMENTS.frame(spark, sf_dir), TEXTS.frame(spark, sf_dir)).select("book_id", "pos", "first_text")


FIRST_SQL = f"SELECT f.book_id, f.pos, arg_min(t.text, t.pos) AS first_text FROM {FRAGMENTS.sql} f JOIN {TEXTS.sql} t ON t.book_id = f.book_id AND t.ch_idx = f.ch_idx AND t.pos >= f.start_idx AND t.pos < f.end_idx GROUP BY f.book_id, f.pos"


QUERIES = {
    "page_heading": Query(page_heading, _HEADING_SQL(PARAS.sql)),
    "toc_pages": Query(toc_pages, TOC_SQL),
    "toc_scan": Query(toc_scan, TOC_SCAN_SQL),
    "sections_pages": Query(sections_pages, SECTIONS_SQL),
    "document_sections": Query(document_sections, DOCUMENT_SECTIONS_SQL),
    "sections_paragraphs": Query(sections_paragraphs, FLAT_SQL),
    "page_to_section": Query(page_to_section, ASOF_SQL),
    "decorative_filter": Query(decorative_filter, DECOR_SQL),
    "decorative_pages": Query(decorative_pages, f"SELECT book_id, sha1, array_to_string(list_sort(list(DISTINCT page_idx)), ',') AS pages FROM ({DECOR_SQL}) WHERE repeats >= 2 GROUP BY book_id, sha1"),
    "image_artifact_rules": Query(image_artifact_rules, ARTIFACT_SQL),
    "pixel_stats": Query(pixel_stats, PIXEL_SQL),
    "histogram_entropy": Query(histogram_entropy, ENTROPY_SQL),
    "cover_pick": Query(cover_pick, COVER_SQL),
    "cover_resolve": Query(cover_resolve, f"SELECT book_id, CASE WHEN book_id = 'a' THEN 'own.jpg' ELSE name END AS cover FROM ({COVER_SQL})"),
    "page_ranges": Query(page_ranges, f"SELECT book_id, ch_idx, page_idx, min(pos) AS start_idx, max(pos) + 1 AS end_idx FROM (SELECT *, CAST(pos // 3 AS INT) AS page_idx FROM {TEXTS.sql}) GROUP BY ALL"),
    "neighbor_text_page": Query(neighbor_text_page, f"SELECT * FROM {_NEAR}"),
    "image_anchors": Query(image_anchors, ANCHOR_SQL),
    "spine_segments": Query(spine_segments, SEGMENT_SQL),
    "front_visual_pairs": Query(front_visual_pairs, FRONT_SQL),
    "interval_merge": Query(interval_merge, f"SELECT * FROM {_MERGED(RANGES.sql, 'book_id, ch_idx')}"),
    "order_intervals": Query(order_intervals, ORDER_SQL),
    "interval_gaps": Query(interval_gaps, GAPS_SQL),
    "fragment_normalize": Query(fragment_normalize, NORMALIZE_SQL),
    "fragment_validate": Query(fragment_validate, VALIDATE_SQL),
    "fragment_suppress": Query(fragment_suppress, SUPPRESS_SQL),
    "fragment_first_text": Query(fragment_first_text, FIRST_SQL),
}

"""Queries over pages, lines and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import profile as P
from ..functions import text as T
from ..operators import lines as L
from ..operators import sections as S
from ..sources.books import recognize
from ..sources.tables import book_pages, spread, table
from . import Query
from . import sqltext as D
from .sqltext import PAGES, Rows

NUMBERS = Rows(
    "id, text",
    "(1, ' 12 '), (2, '12 a'), (3, '12345'), (4, ''), (5, '7'), (6, 'x 7')",
    ("10 + doc_id * 1000000 + line_no", "CASE line_no % 5 WHEN 0 THEN ' ' || doc_id || ' ' ELSE text END"),
    source="document_lines",
)
HEADERS = Rows(
    "id, line",
    "(1, '12'), (2, '— 12 —'), (3, 'Página 12'), (4, 'Mi Novela | 45'), (5, 'Volumen 0 – Blog'), (6, '12345'), (7, 'Capítulo 3'), (8, '1 2 3 4 é5 a6'), (9, 'pag. 3 y pág 4'), (10, '   '), (11, '  a   b  12 ')",
    ("20 + doc_id * 1000000 + line_no", "CASE line_no % 4 WHEN 0 THEN text || ' | ' || line_no WHEN 1 THEN 'Página ' || line_no ELSE text END"),
    source="document_lines",
)
HEADINGS = Rows(
    "id, text",
    "(1, 'CAPÍTULO 1'), (2, '— Capítulo 2: Algo —'), (3, 'capitulos'), (4, 'Parte de la culpa'), (5, 'El Comienzo'), (6, 'Hacía frío aquella noche de invierno.'), (7, 'Era tarde.'), (8, 'Prólogo'), (9, ''), (10, 'Uno ..... 12'), (11, 'Ana Bel | 4'), (12, '44'), (13, 'Short  Story'), (14, '  | agradecimientos |  '), (15, 'Palabras del autor'), (16, 'La Casa de los Sueños Perdidos'), (17, 'Índice'), (18, 'Capítulo 1 ........ 12'), (19, 'Capítulo 1'), (20, 'tocar'), (21, 'Epílogo | 99'), (22, 'Tabla de Contenidos'), (23, 'Texto 33')",
    ("30 + doc_id * 1000000 + line_no", "CASE line_no % 6 WHEN 0 THEN 'Capítulo ' || doc_id || ' ' || text WHEN 1 THEN text || ' ..... ' || line_no WHEN 2 THEN 'Prólogo | ' || line_no ELSE text END"),
    source="document_lines",
)
BLOCKS = Rows(
    "book_id, page_idx, block_no, y_rel, text",
    "('b', 0, 0, 0.95, 'Mi Novela'), ('b', 0, 1, 0.5, 'Hola'), ('b', 1, 0, 0.95, 'Mi Novela'), ('b', 1, 1, 0.05, '12'), ('b', 2, 0, 0.95, 'Mi Novela'), ('b', 2, 1, 0.5, '12'), ('b', 3, 0, 0.95, 'Mi Novela'), ('b', 3, 1, 0.5, 'Mi Novela'), ('b', 3, 2, 0.02, 'Pág. 4'), ('c', 0, 0, 0.95, 'Mi Novela'), ('c', 0, 1, 0.05, '— 3 —')",
    ("book", D.block(3), D.inside(3), D.part(1, 20, 20), D.one_of(2, "status", "CAST(n AS STRING)", "'texto ' || k")),
)
LINES = Rows(
    "book_id, page_idx, line_no, text",
    "('b', 0, 0, 'Era una no-'), ('b', 0, 1, 'che oscura.'), ('b', 0, 2, '—Hola'), ('b', 0, 3, 'dijo él.'), ('b', 1, 0, 'Capítulo 1'), ('b', 1, 1, 'El Comienzo'), ('b', 1, 2, 'Hacía frío aquella noche de invierno.'), ('b', 2, 0, 'Capítulo 1'), ('b', 2, 1, 'Era tarde.'), ('b', 3, 0, 'una línea'), ('b', 3, 1, 'sigue aquí'), ('b', 3, 2, ''), ('b', 3, 3, 'otra'), ('b', 4, 0, 'x'), ('c', 0, 0, 'uno-'), ('c', 0, 1, 'dos-'), ('c', 0, 2, 'tres-'), ('c', 0, 3, 'cuatro'), ('c', 0, 4, 'Prólogo'), ('c', 0, 5, ''), ('c', 0, 6, 'Monólogo De Ana'), ('c', 0, 7, 'y luego'), ('c', 0, 8, 'Más')",
    ("'v' || conv_id", "CAST(turn AS INT)", "line_no", "text"),
    source="turn_lines",
)


def _pages(spark, sf_dir):
    return book_pages(table(spark, sf_dir, "documents"))


def pages_view(spark, sf_dir):
    return _pages(spark, sf_dir).select("book_id", "page_idx", F.length("raw_text").cast("long").alias("n_chars"))


def page_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n_pages"))


def page_number_strip(spark, sf_dir):
    return NUMBERS.frame(spark, sf_dir).select("id", T.without_page_number(F.col("text")).alias("text"))


def visual_separator(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", T.is_separator(F.col("text")).alias("is_separator"), T.is_image_only(F.col("text")).alias("is_image_only"))


def separator_sql(text: str) -> str:
    cleaned = D.without_page_number(text)
    compact = D.collapse(cleaned)
    return f"""(length({compact}) <= 70 OR (len(list_filter({D.lines(cleaned)}, lambda x: {D.strip('x')} <> '')) <= 4
  AND {D.count(compact, f"[{P.LETTERS}']+")} <= 14 AND {D.count(compact, '[.!?¿¡;:]')} <= 1))"""


_COMPACT = D.collapse(D.without_page_number("text"))
_SEPARATOR = separator_sql("text")
VISUAL_SQL = f"SELECT doc_id, {_SEPARATOR} AS is_separator, (length({_COMPACT}) < 20 OR {_SEPARATOR}) AS is_image_only FROM documents"


def _garbage_sql(source: str) -> str:
    return f"""SELECT id, cleaned, CASE WHEN solid = 0 THEN 1.0 ELSE least(1.0, strange / solid
      + CAST(inside AS DOUBLE) / greatest(1, tokens) + CASE WHEN letters / solid < 0.55 THEN 0.25 ELSE 0.0 END) END AS score
    FROM (SELECT id, cleaned, CAST(length(regexp_replace(cleaned, {D.q(f'[{P.SPACE}]')}, '', 'g')) AS DOUBLE) AS solid,
      length(regexp_replace(cleaned, {D.q(f'[{P.ALLOWED}]')}, '', 'g')) AS strange, length(regexp_replace(cleaned, '[^\\p{{L}}]', '', 'g')) AS letters,
      len(list_filter(w, lambda c: {D.fits('c', f'[{P.WORD}]', False)})) AS tokens,
      len(list_filter(w, lambda c: contains(c, '_') OR {D.fits('c', f'[{P.WORD}].*[{P.SUSPICIOUS}].*[{P.WORD}]', False)})) AS inside
      FROM (SELECT id, cleaned, {D.words('cleaned')} AS w FROM (SELECT id, {D.without_page_number('text')} AS cleaned FROM {source})))"""


GARBAGE_SOURCE = "(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)"


def garbage_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return spread(docs.unionByName(pages)).select("id", F.round(T.garbage_score(F.col("text")), 6).alias("score"))


def ocr_decision(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    d = docs.select("doc_id", T.ocr_decision(F.col("text"), mode="auto").alias("d"))
    return d.select("doc_id", "d.must_ocr", F.substring_index("d.reason", " (score", 1).alias("reason"), F.round("d.score", 6).alias("score"))


OCR_SQL = f"""SELECT id AS doc_id, length(cleaned) < 90 OR score >= 0.22 AS must_ocr,
  CASE WHEN length(cleaned) < 90 THEN 'texto escaso (< 90 chars)' WHEN score >= 0.22 THEN 'texto corrupto' ELSE 'texto suficiente' END AS reason,
  round(CASE WHEN length(cleaned) < 90 THEN 1.0 ELSE score END, 6) AS score FROM ({_garbage_sql("(SELECT doc_id AS id, text FROM documents)")})"""


def ocr_apply(spark, sf_dir):
    """Pages with an engine's text where one is needed and it reads some; counts by book.  The pictures of even pages say what the engine reads."""
    pages = _pages(spark, sf_dir).withColumn("must", T.ocr_decision(F.col("raw_text"), mode="auto")["must_ocr"])
    pictures = pages.select("book_id", "page_idx", F.when(F.col("page_idx") % 2 == 0, "recognized").otherwise("").cast("binary").alias("png"))
    read = recognize(pages, pictures, lambda png: bytes(png).decode(), F.col("must"))
    return read.groupBy("book_id").agg(F.count_if("must").alias("n_must"), F.count_if("is_read").alias("n_replaced"), F.sum(F.length("raw_text")).alias("n_chars"))


_PAGE_OCR = _garbage_sql(f"(SELECT book_id || ':' || page_idx AS id, raw_text AS text FROM {PAGES})")
OCR_APPLY_SQL = f"""SELECT book_id, count(*) FILTER (must) AS n_must, count(*) FILTER (must AND page_idx % 2 = 0) AS n_replaced,
  CAST(sum(CASE WHEN must AND page_idx % 2 = 0 THEN 10 ELSE length(raw_text) END) AS BIGINT) AS n_chars
  FROM {PAGES} p JOIN (SELECT id, length(cleaned) < 90 OR score >= 0.22 AS must FROM ({_PAGE_OCR})) o ON o.id = book_id || ':' || page_idx GROUP BY book_id"""


def page_lines(spark, sf_dir):
    return L.page_lines(_pages(spark, sf_dir))


def lines_sql(pages: str) -> str:
    return f"SELECT book_id, page_idx, CAST(i - 1 AS INT) AS line_no, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT book_id, page_idx, {D.lines('raw_text')} AS ls FROM {pages}))"


LINES_SQL = lines_sql(PAGES)


def edge_lines(spark, sf_dir):
    return L.edge_lines(_pages(spark, sf_dir))


EDGE_SQL = f"""SELECT book_id, page_idx, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT book_id, page_idx, {D.lines(D.strip('raw_text'))} AS ls FROM {PAGES}))
  WHERE len(ls) < 6 OR i <= 3 OR i > len(ls) - 3"""
_EDGES = f"(SELECT book_id, page_idx, {D.collapse('text')} AS line FROM ({EDGE_SQL}) WHERE length({D.collapse('text')}) > 2 AND NOT {D.structural('text')})"
EXACT_SQL = f"SELECT book_id, line, count(DISTINCT page_idx) AS n_pages FROM {_EDGES} GROUP BY book_id, line HAVING count(DISTINCT page_idx) >= 4"
NORMALIZED_SQL = f"SELECT book_id, line, n_pages FROM (SELECT book_id, form AS line, count(DISTINCT page_idx) AS n_pages FROM (SELECT book_id, page_idx, {D.header_form('line')} AS form FROM {_EDGES}) WHERE form <> '' GROUP BY book_id, form) WHERE n_pages >= 4"


def repeated_exact(spark, sf_dir):
    return L.repeated(_pages(spark, sf_dir), False)


def repeated_normalized(spark, sf_dir):
    return L.repeated(_pages(spark, sf_dir), True)


def clean_lines(spark, sf_dir):
    return L.clean_lines(_pages(spark, sf_dir))


CLEAN_SQL = f"""WITH l AS (SELECT book_id, page_idx, line_no, {D.collapse('text')} AS text FROM ({LINES_SQL})),
  f AS (SELECT *, {D.header_form('text')} AS form FROM l)
  SELECT book_id, page_idx, line_no, text FROM f WHERE text = '' OR {D.structural('text')} OR NOT (
    EXISTS (SELECT 1 FROM ({EXACT_SQL}) e WHERE e.book_id = f.book_id AND e.line = f.text)
    OR EXISTS (SELECT 1 FROM ({NORMALIZED_SQL}) n WHERE n.book_id = f.book_id AND n.line = f.form)
    OR regexp_matches(text, '^[0-9]{{1,4}}$') OR {D.page_phrase('text')})"""


def border_blocks(spark, sf_dir):
    return L.body_blocks(BLOCKS.frame(spark, sf_dir)).select("book_id", "page_idx", "block_no", "text")


BORDER_SQL = f"""WITH b AS (SELECT *, y_rel > 0.9 OR y_rel < 0.1 AS border FROM {BLOCKS.sql}),
  often AS (SELECT book_id, text FROM b WHERE border GROUP BY book_id, text HAVING count(*) >= 4)
  SELECT book_id, page_idx, block_no, text FROM b WHERE (book_id, text) NOT IN (SELECT (book_id, text) FROM often)
  AND NOT (border AND ({D.fits('text', P.PAGE_PHRASE)} OR {D.fits('text', P.SHORT_PAGE_PHRASE)} OR regexp_matches(text, '^[0-9]{{1,4}}$') OR {D.fits('text', P.DASHED_NUMBER, False)}))"""


def header_footer_form(spark, sf_dir):
    return HEADERS.frame(spark, sf_dir).select("id", T.header_footer_form(F.col("line")).alias("form"))


def heading_lines(spark, sf_dir):
    c = F.col("text")
    return HEADINGS.frame(spark, sf_dir).select("id", T.heading_text(c).alias("heading"), T.is_structural(c).alias("is_structural"), T.is_subtitle(c).alias("is_subtitle"), T.is_short_heading(c).alias("is_short"), T.toc_score(c).alias("toc_score"))


HEADING_SQL = f"""SELECT id, h AS heading, {D.fits('h', P.STRUCTURAL)} AS is_structural, {D.subtitle('h')} AS is_subtitle,
  h <> '' AND length(h) <= 120 AND {D.count('h', '[.]')} < 3 AS is_short, {D.toc_score('h')} AS toc_score FROM (SELECT id, {D.heading('text')} AS h FROM {HEADINGS.sql})"""


def document_headings(spark, sf_dir):
    """The first line of every page against the heading rules."""
    x = L.page_lines(_pages(spark, sf_dir)).where("line_no = 0")
    return x.select("book_id", "page_idx", T.is_structural(F.col("text")).alias("is_structural"), T.is_subtitle(F.col("text")).alias("is_subtitle"), T.toc_score(F.col("text")).alias("toc_score"))


DOC_HEADING_SQL = f"SELECT book_id, page_idx, {D.fits('h', P.STRUCTURAL)} AS is_structural, {D.subtitle('h')} AS is_subtitle, {D.toc_score('h')} AS toc_score FROM (SELECT book_id, page_idx, {D.heading('text')} AS h FROM ({LINES_SQL}) WHERE line_no = 0)"


def fold_sql(source: str) -> str:
    """The paragraphs by a fold over the lines, one at a time."""
    opens = f"(nxt <> '' AND ({D.structural('nxt')} OR {D.fits('nxt', P.SENTENCE_START, False)} OR {D.fits('nxt', P.DIALOGUE_START, False)}))"
    return f"""WITH RECURSIVE n AS (
      SELECT book_id, page_idx, CAST(row_number() OVER w - 1 AS INT) AS i, {D.strip('text')} AS t, coalesce(lead({D.strip('text')}) OVER w, '') AS nxt FROM {source}
      WINDOW w AS (PARTITION BY book_id, page_idx ORDER BY line_no)
    ), l AS MATERIALIZED (
      SELECT book_id, page_idx, i, t, nxt, {D.structural('t')} AS head, {D.subtitle('h')} AS sub, {D.fits('t', P.PARAGRAPH_END, False)} AS ends, {opens} AS opens, h, regexp_matches(nxt, '^\\p{{Ll}}') AS low FROM (SELECT *, {D.heading('t')} AS h FROM n)
    ), f AS (
      SELECT book_id, page_idx, -1 AS i, false AS taken, false AS after_head, false AS running, 0 AS para, '' AS piece, false AS glue FROM (SELECT DISTINCT book_id, page_idx FROM l)
      UNION ALL
      SELECT book_id, page_idx, i, NOT was_taken AND joins, CASE WHEN t = '' THEN was_head ELSE head END,
        CASE WHEN t = '' THEN false WHEN was_taken THEN true ELSE NOT solo AND (joins OR NOT (ends OR opens)) END,
        CASE WHEN t = '' OR was_taken OR (was_running AND NOT solo) THEN para ELSE para + 1 END,
        CASE WHEN t = '' THEN NULL WHEN was_taken THEN t WHEN solo THEN h WHEN joins THEN left(t, -1) ELSE t END, was_taken
      FROM (SELECT l.*, f.taken AS was_taken, f.after_head AS was_head, f.running AS was_running, f.para,
          t <> '' AND (head OR (f.after_head AND sub)) AS solo, t <> '' AND NOT (head OR (f.after_head AND sub)) AND suffix(t, '-') AND low AS joins
        FROM f JOIN l ON l.book_id = f.book_id AND l.page_idx = f.page_idx AND l.i = f.i + 1)
    ), p AS (
      SELECT book_id, page_idx, para, string_agg(CASE WHEN glue OR rn = 1 THEN piece ELSE ' ' || piece END, '' ORDER BY i) AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_idx, para ORDER BY i) AS rn FROM f WHERE i >= 0 AND piece IS NOT NULL) GROUP BY ALL
    )
    SELECT book_id, page_idx, CAST(row_number() OVER (PARTITION BY book_id, page_idx ORDER BY para) - 1 AS INT) AS para_no, {D.strip('text')} AS text FROM p WHERE length({D.strip('text')}) > 1"""


def paragraphs(spark, sf_dir):
    return L.paragraphs(LINES.frame(spark, sf_dir))


def document_paragraphs(spark, sf_dir):
    return L.paragraphs(L.page_lines(_pages(spark, sf_dir)))


def dialog_system(spark, sf_dir):
    x = L.paragraphs(L.page_lines(_pages(spark, sf_dir)))
    return S.dialogue_system(x.select("book_id", F.col("page_idx").alias("ch_idx"), F.col("para_no").alias("pos"), "text"))


DIALOG_SQL = f"""WITH p AS ({fold_sql(f'({LINES_SQL})')}), c AS (
  SELECT book_id, CASE WHEN regexp_matches(text, '^[—–]') THEN 1 WHEN regexp_matches(text, '^─') THEN 2 WHEN regexp_matches(text, '^["«“]') THEN 3 ELSE 4 END AS k, count(*) AS n FROM p WHERE para_no < 20 GROUP BY ALL)
  SELECT book_id, ['guion', 'guion2', 'comillas', 'none'][k] AS system, n FROM c QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, k) = 1"""


def flat_text(spark, sf_dir):
    """Each page's paragraphs as one text, and its preview."""
    x = L.paragraphs(L.page_lines(_pages(spark, sf_dir)))
    t = x.groupBy("book_id", "page_idx").agg(F.array_join(F.array_sort(F.collect_list(F.struct("para_no", "text")))["text"], "\n\n").alias("t"))
    return t.select("book_id", "page_idx", F.md5("t").alias("md5"), F.substring("t", 1, 500).alias("preview"))


FLAT_SQL = f"SELECT book_id, page_idx, md5(t) AS md5, left(t, 500) AS preview FROM (SELECT book_id, page_idx, string_agg(text, chr(10) || chr(10) ORDER BY para_no) AS t FROM ({fold_sql(f'({LINES_SQL})')}) GROUP BY ALL)"

QUERIES = {
    "pages_view": Query(pages_view, f"SELECT book_id, page_idx, length(raw_text) AS n_chars FROM {PAGES}"),
    "page_counts": Query(page_counts, "SELECT source AS book_id, count(*) AS n_pages FROM documents GROUP BY source"),
    "page_number_strip": Query(page_number_strip, f"SELECT id, {D.without_page_number('text')} AS text FROM {NUMBERS.sql}"),
    "visual_separator": Query(visual_separator, VISUAL_SQL),
    "garbage_score": Query(garbage_score, f"SELECT id, round(score, 6) AS score FROM ({_garbage_sql(GARBAGE_SOURCE)})"),
    "ocr_decision": Query(ocr_decision, OCR_SQL),
    "ocr_apply": Query(ocr_apply, OCR_APPLY_SQL),
    "page_lines": Query(page_lines, LINES_SQL),
    "edge_lines": Query(edge_lines, EDGE_SQL),
    "repeated_exact": Query(repeated_exact, EXACT_SQL),
    "repeated_normalized": Query(repeated_normalized, NORMALIZED_SQL),
    "clean_lines": Query(clean_lines, CLEAN_SQL),
    "border_blocks": Query(border_blocks, BORDER_SQL),
    "header_footer_form": Query(header_footer_form, f"SELECT id, {D.header_form('x')} AS form FROM (SELECT id, {D.collapse('line')} AS x FROM {HEADERS.sql})"),
    "heading_lines": Query(heading_lines, HEADING_SQL),
    "document_headings": Query(document_headings, DOC_HEADING_SQL),
    "paragraphs": Query(paragraphs, fold_sql(LINES.sql)),
    "document_paragraphs": Query(document_paragraphs, fold_sql(f"({LINES_SQL})")),
    "dialog_system": Query(dialog_system, DIALOG_SQL),
    "flat_text": Query(flat_text, FLAT_SQL),
}

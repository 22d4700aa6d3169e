"""Queries over markup, the package's files, metadata and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import package as K
from ..operators import templates
from ..profile import BREAK
from ..plans.book import archive_of, assemble, unique_names, write_books
from ..sources.archives import read_entries
from ..sources.shelf import Shelf
from ..sources.tables import book_pages, table
from . import Query
from .structure import TEXTS
from .sqltext import Rows, block, inside, one_of, pick, q, strip

SECTIONS = Rows(
    "book_id, ch_idx, title, subtitle, section_kind",
    "('b', 0, 'Uno & dos', 'Sub <a>', 'chapter'), ('b', 1, 'Parte 2', '', 'part')",
    ("book", block(6), "'Capítulo ' || n || ' & <' || priority || '>'", one_of(1, "''", "'Sub <' || k || '>'"), one_of(2, "'part'", "'chapter'", "'epilogue'")),
    where="n % 6 = 0",
)
PIECES = Rows(
    "book_id, pos, ch_idx, start_idx, end_idx, include_header, hidden",
    "('b', 0, 0, 0, 3, true, ''), ('b', 1, 0, 5, 9, false, 'x.jpg'), ('b', 2, 1, 0, 4, true, '')",
    ("book", "n", block(6), inside(6), f"{inside(6)} + 2", "n % 6 = 0", one_of(3, "''", "'m' || (n + 1) || '.jpg'")),
    where="n % 2 = 0",
)
ANCHORS = Rows(
    "book_id, ch_idx, after_para_idx, imgname, caption, layout",
    "('b', 0, -1, 'f.jpg', '', 'fullblock'), ('b', 0, 1, 'm.jpg', 'pie & más', 'inline'), ('b', 0, 4, 'x.jpg', '', 'inline'), ('b', 0, 8, 'z.jpg', '', 'inline'), ('b', 0, 2, 'm.jpg', '', 'inline'), ('b', 1, 99, 'q.jpg', '', 'inline')",
    ("book", block(6), f"{inside(6)} - 1", "'m' || n || '.jpg'", one_of(5, "''", "'pie & ' || k"), one_of(6, "'inline'", "'fullblock'")),
    where=f"{pick(4, 2)} = 0",
)
SPINE = Rows(
    "book_id, pos, type, ch_idx, label",
    "('b', 0, 'img_page', -1, ''), ('b', 1, 'chapter_fragment', 0, 'Uno & dos'), ('b', 2, 'img_sequence', -1, ''), ('b', 3, 'chapter_fragment', 0, 'Uno & dos'), ('b', 4, 'chapter_fragment', 1, 'Parte 2'), ('c', 0, 'chapter_fragment', 0, 'Solo')",
    ("book", "n", one_of(1, "'img_page'", "'img_sequence'", "'chapter_fragment'", "'chapter_fragment'"), f"CASE WHEN {pick(1, 4)} < 2 THEN -1 ELSE {block(3)} END", f"'Uno & ' || {block(3)}"),
)
BOOKS = Rows(
    "book_id, uuid, title, author, lang, publisher, date",
    "('b', 'u-1', 'A & B', 'Ana', 'es', '', '2026'), ('c', 'u-2', 'C', 'D <d>', 'en', 'P', '1999')",
    ("book", "'u-' || c", "'Libro & ' || k", "'Ana <' || priority || '>'", one_of(1, "'es'", "'en'"), one_of(2, "''", "'P & P'"), "'2026'"),
    where="n = 0",
)
MANIFEST = Rows(
    "book_id, seq, id, href, media_type",
    "('b', 0, 'cover-image', 'Images/cover.jpg', 'image/jpeg'), ('b', 1, 'cap001', 'Text/001.xhtml', 'application/xhtml+xml'), ('c', 0, 'cap001', 'Text/001.xhtml', 'application/xhtml+xml')",
    ("book", "n", f"CASE WHEN n = 0 AND {pick(1, 2)} = 0 THEN 'cover-image' ELSE 'cap' || n END", "'Text/' || n || '.xhtml'", "'application/xhtml+xml'"),
)
REFS = Rows(
    "book_id, seq, idref",
    "('b', 0, 'cover'), ('b', 1, 'cap001'), ('c', 0, 'cap001')",
    ("book", "n", "'cap' || n"),
)
POINTS = Rows(
    "book_id, play_order, label, src",
    "('b', 1, 'Uno & dos', 'Text/001.xhtml'), ('b', 2, 'Dos', 'Text/003.xhtml')",
    ("book", "n + 1", "'Parte & ' || n", "'Text/' || n || '.xhtml'"),
)
META = Rows(
    "id, given, found, stem",
    "(1, '', '', 'fichero'), (2, 'Mío', 'PDF', 'x'), (3, '', 'PDF', 'x'), (4, CAST(NULL AS STRING), CAST(NULL AS STRING), 'y')",
    ("10 + k", one_of(1, "''", "NULL", "'Mío ' || k"), one_of(2, "''", "NULL", "'PDF ' || priority"), "'f' || k"),
)
STEMS = Rows(
    "id, value",
    "(1, 'Mi: Libro?'), (2, ''), (3, '***'), (4, 'a_b - c'), (5, '  Ñandú 2  '), (6, CAST(NULL AS STRING))",
    ("10 + doc_id * 1000000 + line_no", "text"),
    source="document_lines",
)
GALLERIES = Rows(
    "book_id, pos, seq, name, caption",
    "('b', 0, 0, 'a.jpg', 'A & a'), ('b', 0, 1, 'b.jpg', ''), ('b', 1, 0, 'c.jpg', 'C')",
    ("book", block(3), inside(3), "'g' || k || '.jpg'", one_of(1, "''", "'A & ' || k")),
)


def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.escape_xml(F.col("text"))).alias("md5"))


_ESCAPE = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_STYLE = lambda x: f"regexp_replace(regexp_replace({x}, '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g'), '\\*(.+?)\\*', '<i>\\1</i>', 'g')"


def inline_styles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.inline_styles(F.col("text"))).alias("md5"))


def para_html(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("book_id", "ch_idx").orderBy("pos")) == 1
    return TEXTS.frame(spark, sf_dir).withColumn("first", first).select("book_id", "ch_idx", "pos", M.paragraph_html(F.col("text"), F.col("first")).alias("html"))


_PARA = lambda text, first: f"(CASE WHEN {first} THEN '<p class=\"asangre\">' ELSE '<p>' END || {_STYLE(_ESCAPE(text))} || '</p>')"


def fragment_html(spark, sf_dir):
    pieces = PIECES.frame(spark, sf_dir).withColumn("suppress_images", F.filter(F.split("hidden", ","), lambda x: x != ""))
    return K.fragment_bodies(pieces, SECTIONS.frame(spark, sf_dir), TEXTS.frame(spark, sf_dir), ANCHORS.frame(spark, sf_dir)).select("book_id", "pos", "body")


FRAGMENT_SQL = f"""WITH s AS {SECTIONS.sql}, f AS {PIECES.sql},
  head AS (SELECT f.book_id, f.pos, -2 AS place, 0 AS kind, '' AS name, CASE WHEN section_kind = 'part' THEN '<h3 class="part-title">' || {_ESCAPE('title')} || '</h3>' ELSE '<h1 class="chapter-title">' || {_ESCAPE('title')} || '</h1>' END
    || CASE WHEN subtitle <> '' THEN chr(10) || '<h2 class="chapter-subtitle">' || {_ESCAPE('subtitle')} || '</h2>' ELSE '' END AS html FROM f JOIN s USING (book_id, ch_idx) WHERE include_header),
  para AS (SELECT book_id, pos, place, 1 AS kind, '' AS name, {_PARA('text', 'rn = 1')} AS html FROM (SELECT f.book_id, f.pos, t.pos AS place, t.text, row_number() OVER (PARTITION BY f.book_id, f.pos ORDER BY t.pos) AS rn
    FROM f JOIN {TEXTS.sql} t ON t.book_id = f.book_id AND t.ch_idx = f.ch_idx AND t.pos >= f.start_idx AND t.pos < f.end_idx)),
  pic AS (SELECT f.book_id, f.pos, after_para_idx AS place, 2 AS kind, imgname AS name, '<div class="dimg' || CASE WHEN layout = 'fullblock' THEN ' fullblock' ELSE '' END || '">' || chr(10) || '  <img alt="ilustración" src="../Images/' || imgname || '"/>' || chr(10) || '</div>'
    || CASE WHEN caption <> '' THEN chr(10) || '<p class="centrado"><i>' || {_ESCAPE('caption')} || '</i></p>' ELSE '' END AS html FROM f JOIN {ANCHORS.sql} a ON a.book_id = f.book_id AND a.ch_idx = f.ch_idx AND after_para_idx >= start_idx - 1 AND after_para_idx < end_idx AND imgname <> hidden
    QUALIFY row_number() OVER (PARTITION BY f.book_id, f.pos, imgname ORDER BY after_para_idx) = 1)
  SELECT book_id, pos, string_agg(html, chr(10) ORDER BY place, kind, name) AS body FROM (SELECT * FROM head UNION ALL SELECT * FROM para UNION ALL SELECT * FROM pic) GROUP BY book_id, pos"""


def spine_names(spark, sf_dir):
    return K.name_items(SPINE.frame(spark, sf_dir)).select("book_id", "pos", "file", "idref", "in_nav")


_COUNT = "row_number() OVER (PARTITION BY book_id, type = 'chapter_fragment' ORDER BY pos)"
NAMES_SQL = f"""SELECT book_id, pos, CASE WHEN type = 'chapter_fragment' THEN lpad(CAST({_COUNT} AS VARCHAR), 3, '0') || '.xhtml' ELSE 'img_' || lpad(CAST({_COUNT} AS VARCHAR), 3, '0') || '.xhtml' END AS file,
  CASE WHEN type = 'chapter_fragment' THEN 'cap' ELSE 'imgpage' END || lpad(CAST({_COUNT} AS VARCHAR), 3, '0') AS idref, type = 'chapter_fragment' AND pos = min(pos) OVER (PARTITION BY book_id, type, ch_idx) AS in_nav FROM {SPINE.sql}"""


def nav_points(spark, sf_dir):
    return K.nav_points(K.name_items(SPINE.frame(spark, sf_dir)))


NAV_SQL = f"SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) AS INT) AS play_order, label, 'Text/' || file AS src FROM ({NAMES_SQL}) JOIN {SPINE.sql} USING (book_id, pos) WHERE in_nav"


def manifest_opf(spark, sf_dir):
    return K.opf(BOOKS.frame(spark, sf_dir), MANIFEST.frame(spark, sf_dir), REFS.frame(spark, sf_dir))


def _printf(template: str, *args: str) -> str:
    parts = template.replace("%d", "%s").split("%s")
    out = [q(parts[0])]
    for arg, part in zip(args, parts[1:]):
        out += [f"CAST({arg} AS VARCHAR)", q(part)]
    return " || ".join(out)


_ITEM_SQL = _printf('<item id="%s" href="%s" media-type="%s"/>', "id", "href", "media_type")
_ITEMS_XML = "coalesce(items, '')"
_REFS_XML = "coalesce(refs, '')"
_COVER_META = "CASE WHEN cover THEN chr(10) || '    <meta name=\"cover\" content=\"cover-image\"/>' ELSE '' END"
_INDENT = "chr(10) || '    '"
OPF_SQL = f"""SELECT book_id, {_printf(templates.OPF, _ESCAPE('title'), _ESCAPE('author'), 'lang', _ESCAPE('publisher'), 'uuid', 'date', _COVER_META, _ITEMS_XML, _REFS_XML)} AS opf
  FROM {BOOKS.sql} LEFT JOIN (SELECT book_id, string_agg({_ITEM_SQL}, {_INDENT} ORDER BY seq) AS items, bool_or(id = 'cover-image') AS cover FROM {MANIFEST.sql} GROUP BY book_id) USING (book_id)
  LEFT JOIN (SELECT book_id, string_agg('<itemref idref="' || idref || '"/>', {_INDENT} ORDER BY seq) AS refs FROM {REFS.sql} GROUP BY book_id) USING (book_id)"""


def nav_ncx(spark, sf_dir):
    return K.ncx(BOOKS.frame(spark, sf_dir), POINTS.frame(spark, sf_dir))


_NAV_XML = "coalesce(nav, '')"
NCX_SQL = f"SELECT book_id, {_printf(templates.NCX, 'lang', 'uuid', _ESCAPE('title'), _NAV_XML)} AS ncx FROM {BOOKS.sql} LEFT JOIN (SELECT book_id, string_agg({_printf(templates.NAV_POINT, 'play_order', 'play_order', _ESCAPE('label'), 'src')}, chr(10) ORDER BY play_order) AS nav FROM {POINTS.sql} GROUP BY book_id) USING (book_id)"


def image_galleries(spark, sf_dir):
    images = F.array_sort(F.collect_list(F.struct("seq", "name", "caption")))
    return GALLERIES.frame(spark, sf_dir).groupBy("book_id", "pos").agg(K.gallery(images).alias("body"), F.array_join(F.array_sort(F.collect_set(K.image_id(F.col("name")))), " ").alias("ids"))


#: The formats stand here once more in words of their own, so that a wrong one in the templates shows.
_CAPTION = f"CASE WHEN caption <> '' THEN chr(10) || '<p class=\"centrado\"><i>' || {_ESCAPE('caption')} || '</i></p>' ELSE '' END"
_PAGE = lambda lang, title, body: f"""'<?xml version="1.0" encoding="utf-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN"
  "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">

<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="' || {lang} || '">
<head>
  <title>' || {title} || '</title>
  <link href="../Styles/style.css" rel="stylesheet" type="text/css"/>
</head>

<body>
' || {body} || '
</body>
</html>
'"""  # noqa: E731
GALLERY_SQL = f"""SELECT book_id, pos, '<div class="galeria">' || chr(10) || string_agg('<div class="dimg fullblock">' || chr(10) || '  <img alt="ilustración" src="../Images/' || name || '"/>' || chr(10) || '</div>' || {_CAPTION}, chr(10) ORDER BY seq) || chr(10) || '</div>' AS body,
  string_agg('img-' || replace(name, '.', '-'), ' ' ORDER BY name) AS ids FROM {GALLERIES.sql} GROUP BY book_id, pos"""


def meta_precedence(spark, sf_dir):
    return META.frame(spark, sf_dir).select("id", M.first_filled(F.col("given"), F.col("found"), F.col("stem")).alias("title"), M.first_filled(F.col("given"), F.col("found"), F.lit("Desconocido")).alias("author"))


def safe_stem(spark, sf_dir):
    return STEMS.frame(spark, sf_dir).select("id", M.safe_stem(F.col("value")).alias("stem"), M.safe_stem(F.col("value"), "libro", 5).alias("short"))


_STEM = strip("regexp_replace(coalesce(value, ''), '[^\\p{L}\\p{N}_\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\-]', '', 'g')")


def unique_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Libro "), "c_mktsegment").alias("stem"))
    return unique_names(c, "id", "stem", ".epub")


EXPORT_SQL = "SELECT c_custkey AS id, 'Libro ' || c_mktsegment || CASE WHEN rn > 1 THEN ' (' || rn || ')' ELSE '' END || '.epub' AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer)"


def job_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("job_id")).agg(F.round(F.sum(F.octet_length("text")) / 1024, 1).alias("size_kb"), F.count("*").alias("pages"), F.count_if(F.col("lang") == "es").alias("mapped"), F.countDistinct("lang").alias("chapters"))


SUMMARY_SQL = "SELECT source AS job_id, round(sum(strlen(text)) / 1024, 1) AS size_kb, count(*) AS pages, count(*) FILTER (lang = 'es') AS mapped, count(DISTINCT lang) AS chapters FROM documents GROUP BY source"


def job_status(spark, sf_dir):
    return job_summary(spark, sf_dir).where("job_id = 'src0'")


def epub_archive(spark, sf_dir):
    """The files of the archive of the fragments, read back: place, way of storing and hash of each."""
    return K.archive_entries(archive_of(fragment_html(spark, sf_dir))).select("book_id", "seq", "path", "stored", F.sha2("content", 256).alias("sha256"))


ARCHIVE_SQL = f"""WITH t AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) AS INT) AS n, body FROM ({FRAGMENT_SQL})),
  f(k, path, stored, content) AS (VALUES (0, 'mimetype', true, 'application/epub+zip'), (1, 'META-INF/container.xml', false, '<?xml version="1.0" encoding="utf-8"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">
  <rootfiles>
    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>
  </rootfiles>
</container>
'), (2, 'OEBPS/Styles/style.css', false, {q(templates.STYLE)}))
  SELECT book_id, CAST(k AS INT) AS seq, path, stored, sha256(content) AS sha256 FROM (SELECT DISTINCT book_id FROM t), f
  UNION ALL SELECT book_id, n + 2, 'OEBPS/Text/' || lpad(CAST(n AS VARCHAR), 3, '0') || '.xhtml', false, sha256({_PAGE("'es'", 'book_id', 'body')}) FROM t"""


def book_archives(spark, sf_dir):
    """The whole job: every document a page, every source a book; the files of each archive, read back."""
    none = spark.createDataFrame([], "book_id string, page_idx int, img_no int, name string, is_full_page boolean, caption string")
    folder = Shelf(spark).folder()
    names = write_books(assemble(book_pages(table(spark, sf_dir, "documents")), none), folder)
    found = read_entries(spark, folder).withColumnRenamed("book_id", "name").join(names, "name")
    return found.select("book_id", "path", "stored", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def cover_pages(spark, sf_dir):
    x = BOOKS.frame(spark, sf_dir)
    return x.select("book_id", K.cover_page(F.col("lang"), F.col("book_id") == "b", F.col("title"), F.col("author")).alias("page"))


_COVER_BODY = f"""CASE WHEN book_id = 'b' THEN '<div class="cubierta">' || chr(10) || '  <img alt="portada" src="../Images/cover.jpg"/>' || chr(10) || '</div>'
  ELSE '<h1 class="titulo">' || {_ESCAPE('title')} || '</h1>' || chr(10) || '<h2 class="subtitulo">' || {_ESCAPE('author')} || '</h2>' END"""


def image_pages(spark, sf_dir):
    return GALLERIES.frame(spark, sf_dir).select("name", K.image_page(F.lit("es"), F.lit("Imagen"), F.col("name"), F.col("caption")).alias("page"))


_IMAGE_BODY = f"""'<div class="pagina">' || chr(10) || '  <div class="dimg fullblock">' || chr(10) || '    <img alt="ilustración" src="../Images/' || name || '"/>' || chr(10) || '  </div>' || {_CAPTION} || chr(10) || '</div>'"""


def image_captions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(M.caption(F.concat(F.lit("12\n\n"), "text"), F.col("doc_id") % 5 == 0)).alias("md5"))


_LINE_LIST = f"list_filter(list_transform(string_split_regex(text, {q(BREAK)}), lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]{{1,4}}$'))"


def export_names(spark, sf_dir):
    started = F.to_timestamp(F.lit("2024-03-01 10:20:30"))
    return STEMS.frame(spark, sf_dir).select("id", M.export_name(F.col("value")).alias("name"), M.job_name(started, F.col("value"), F.sha1(F.col("id").cast("string"))).alias("job"))


QUERIES = {
    "cover_pages": Query(cover_pages, f"SELECT book_id, {_PAGE('lang', q('Portada'), _COVER_BODY)} AS page FROM {BOOKS.sql}"),
    "image_pages": Query(image_pages, f"SELECT name, {_PAGE(q('es'), q('Imagen'), _IMAGE_BODY)} AS page FROM {GALLERIES.sql}"),
    "image_captions": Query(image_captions, f"SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string({_LINE_LIST}, ' ') END) AS md5 FROM documents"),
    "export_names": Query(export_names, f"SELECT id, coalesce(nullif(left(s, 80), ''), 'libro') || '.epub' AS name, '20240301-102030_' || coalesce(nullif(s, ''), 'libro') || '_' || left(sha1(CAST(id AS VARCHAR)), 6) AS job FROM (SELECT id, {_STEM} AS s FROM {STEMS.sql.replace('AS STRING', 'AS VARCHAR')})"),
    "xml_escape": Query(xml_escape, f"SELECT doc_id, md5({_ESCAPE('text')}) AS md5 FROM documents"),
    "inline_styles": Query(inline_styles, f"SELECT doc_id, md5({_STYLE('text')}) AS md5 FROM documents"),
    "para_html": Query(para_html, f"SELECT book_id, ch_idx, pos, {_PARA('text', 'pos = min(pos) OVER (PARTITION BY book_id, ch_idx)')} AS html FROM {TEXTS.sql}"),
    "fragment_html": Query(fragment_html, FRAGMENT_SQL),
    "spine_names": Query(spine_names, NAMES_SQL),
    "nav_points": Query(nav_points, NAV_SQL),
    "manifest": Query(manifest_opf, OPF_SQL),
    "nav_ncx": Query(nav_ncx, NCX_SQL),
    "image_galleries": Query(image_galleries, GALLERY_SQL),
    "meta_precedence": Query(meta_precedence, f"SELECT id, coalesce(nullif(given, ''), nullif(found, ''), stem) AS title, coalesce(nullif(given, ''), nullif(found, ''), 'Desconocido') AS author FROM {META.sql.replace('AS STRING', 'AS VARCHAR')}"),
    "safe_stem": Query(safe_stem, f"SELECT id, coalesce(nullif(s, ''), 'libro') AS stem, coalesce(nullif(left(s, 5), ''), 'libro') AS short FROM (SELECT id, {_STEM} AS s FROM {STEMS.sql.replace('AS STRING', 'AS VARCHAR')})"),
    "unique_export": Query(unique_export, EXPORT_SQL),
    "job_summary": Query(job_summary, SUMMARY_SQL),
    "job_status": Query(job_status, SUMMARY_SQL.replace("GROUP BY", "WHERE source = 'src0' GROUP BY")),
    "epub_archive": Query(epub_archive, ARCHIVE_SQL),
    "book_archives": Query(book_archives),
}

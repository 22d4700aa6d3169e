"""Golden rows of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.functions import markup as M
from folioloom.functions import text as T


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x string")
    return [r.y for r in rows.select("id", make(F.col("x")).alias("y")).orderBy("id").collect()]


@pytest.mark.parametrize(
    "make, cases",
    [
        (T.header_footer_form, {"12": "<PAGE_NUM>", "— 12 —": "<PAGE_NUM>", "Página 12": "Página <PAGE_NUM>", "Mi Novela | 45": "Mi Novela | <PAGE_NUM>", "Volumen 0 – Blog": "Volumen <PAGE_NUM> – Blog", "12345": "12345", "Capítulo 3": "", "1 2 3 4 é5 a6": "<PAGE_NUM> <PAGE_NUM> <PAGE_NUM> <PAGE_NUM> é5 a6"}),
        (T.without_page_number, {" 12 ": "", "12 a": "12 a", "": "", None: ""}),
        (lambda c: F.round(T.garbage_score(c), 6), {"Hola mundo": 0.0, "": 1.0, "1234": 1.0, "12 34 56 78 90": 0.25, "###": 0.25, "日本語": 1.0, None: 1.0}),
        (T.toc_score, {"Índice": 4, "Capítulo 1 ........ 12": 6, "Capítulo 1": 3, "Prólogo": 2, "tocar": 4, "": 0}),
        (T.is_subtitle, {"Era tarde.": True, "Hacía frío aquella noche de invierno.": False, "Capítulo 1": False, "": False}),
        (M.escape_xml, {"a<b&c": "a&lt;b&amp;c"}),
        (M.inline_styles, {"**a** *b*": "<b>a</b> <i>b</i>"}),
        (lambda c: M.paragraph_html(c, F.lit(True)), {"Hola": '<p class="asangre">Hola</p>'}),
        (M.safe_stem, {"Mi: Libro?": "Mi Libro", "": "libro", None: "libro"}),
        (lambda c: F.array_join(T.lines(c), "|"), {"a\n\nb\n": "a||b", "a\r\nb\x0bc": "a|b|c", "": "", None: ""}),
    ],
)
def test_golden(spark, make, cases):
    assert column(spark, list(cases), make) == list(cases.values())


def test_ocr_modes(spark):
    rows = spark.createDataFrame([("corto",)], "x string")
    for mode, want in {"off": (False, "ocr desactivado", 0.0), "force": (True, "modo force", 1.0), "auto": (True, "texto escaso (< 90 chars)", 1.0)}.items():
        assert tuple(rows.select(T.ocr_decision(F.col("x"), mode=mode).alias("d")).first().d) == want


@pytest.mark.parametrize(
    "paras, want",
    [
        (["Capítulo 1: Lanzamiento", "cuerpo"], ("chapter", "Capítulo 1", "Lanzamiento", 1)),
        (["Prólogo", "Monólogo De Atsuomi"], ("prologue", "Prólogo", "Monólogo De Atsuomi", 2)),
        (["PART 3"], ("part", "Parte 3", "", 1)),
        (["Capítulo IV"], ("chapter", "Capítulo Iv", "", 1)),
        (["1. Inicio del viaje"], ("chapter", "Capítulo 1", "Inicio del viaje", 1)),
        (["Interludio"], None),
        ([], None),
    ],
)
def test_page_heading(spark, paras, want):
    row = spark.createDataFrame([(paras,)], "p array<string>").select(T.page_heading(F.col("p")).alias("h")).first().h
    assert (tuple(row) if row else None) == want


def test_terminal_heading_needs_leave(spark):
    row = spark.createDataFrame([(["Epílogo"],)], "p array<string>")
    assert row.select(T.page_heading(F.col("p"), False).alias("h")).first().h is None
    assert row.select(T.page_heading(F.col("p"), True).alias("h")).first().h.kind == "epilogue"


def test_white_space_forms(spark):
    odd = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    texts = [odd, f"{odd}a{odd}b c  d{odd}", "a b", " a", "​a​", "é　ñ", "", None, "—| Prólogo |—　", " capítulo 1"]
    want = [" ".join(t.split()) if t is not None else None for t in texts]
    assert column(spark, texts, T.collapse) == want
    assert column(spark, texts, T.strip) == [t if t is None else t.strip() for t in texts]
    assert column(spark, texts, T.is_structural) == [False] * 8 + [True, True]


def test_numbered_pages_by_blocks(spark, monkeypatch):
    from folioloom.sources import tables

    rows = [(d, "ab"[d % 2] if d % 5 else None, f"t{d}") for d in random.Random(1).sample(range(200), 120)]
    monkeypatch.setattr(tables, "NUMBERED", 16)
    got = {(r.book_id, r.page_idx): r.raw_text for r in tables.book_pages(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    want = {(s, k): t for s in ("a", "b", None) for k, (_, t) in enumerate(sorted((d, t) for d, x, t in rows if x == s))}
    assert got == want


def test_texts_with_single_spaces_are_not_rewritten(spark):
    texts = ["una línea sin más", "dos  espacios", "a\tb", "x y", " 　z  w\n"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", F.col("x").rlike(T.P.ODD_SPACE).alias("odd"), T.collapse(F.col("x")).alias("made")).collect()
    assert [(r.odd, r.made) for r in sorted(rows, key=lambda r: r.k)] == [(False, "una línea sin más"), (False, "dos espacios"), (True, "a b"), (True, "x y"), (True, "z w")]


def test_texts_stay_out_of_the_windows_over_books(spark):
    from folioloom.operators.sections import sections

    pages = [("b", 0, ["Antes de todo, un texto que no es corto y que dice algo más de lo que dice un separador."]), ("b", 1, ["Capítulo 1: Uno", "a. " * 40, "b. " * 40]), ("b", 2, []), ("b", 3, ["c. " * 40]), (None, 0, ["d. " * 40])]
    told, text, page_map = sections(spark.createDataFrame(pages, "book_id string, page_idx int, paras array<string>"))
    assert sorted((r.ch_idx, r.pos, r.page_idx, r.text[:2]) for r in text.where("book_id = 'b'").collect()) == [(0, 0, 0, "An"), (1, 0, 1, "a."), (1, 1, 1, "b."), (1, 2, 3, "c.")]
    assert [(r.pos, r.text[:2]) for r in text.where("book_id is null").collect()] == [(0, "d.")]
    assert sorted((r.book_id or "", r.title) for r in told.collect()) == [("", "Introducción"), ("b", "Capítulo 1"), ("b", "Introducción")] and page_map.count() == 5
    assert "Window" not in text._jdf.queryExecution().toString()

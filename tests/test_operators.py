"""Operators against hand-made rows and plain folds."""

import random
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import functions as F

from folioloom.operators import lines as L
from folioloom.operators import spine as Z
from folioloom.plans.book import build
from folioloom.sources import books, config
from folioloom.streaming.landing import watch


def test_repeats_count_pages_once(spark):
    pages = [("b", k, f"Mi Novela | {k}\ncuerpo {'x' * k} largo") for k in range(1, 5)] + [("c", 0, "igual\nigual\nigual\nigual")]
    frame = spark.createDataFrame(pages, "book_id string, page_idx int, raw_text string")
    assert L.repeated(frame, False).count() == 0
    assert [tuple(r) for r in L.repeated(frame, True).collect()] == [("b", "Mi Novela | <PAGE_NUM>", 4)]
    assert L.repeated(frame.where("page_idx < 4"), True).count() == 0


def test_cleaning_keeps_headings(spark):
    pages = [("b", k, f"Capítulo {k}\nCabecera fija\ntexto {'y' * k}") for k in range(5)]
    frame = spark.createDataFrame(pages, "book_id string, page_idx int, raw_text string")
    kept = [r.text for r in L.clean_lines(frame).collect()]
    assert sum(t.startswith("Capítulo") for t in kept) == 5 and "Cabecera fija" not in kept


def test_intervals_cover_everything(spark):
    rng = random.Random(3)
    rows = [(str(k % 40), 0, s, s + rng.randint(1, 5)) for k in range(300) for s in [rng.randint(0, 25)]]
    ranges = spark.createDataFrame(rows, "book_id string, ch_idx int, start_idx int, end_idx int")
    totals = ranges.groupBy("book_id", "ch_idx").agg((F.max("end_idx") + 3).alias("total"))
    merged = Z.merge_intervals(ranges).select("book_id", "start_idx", "end_idx").collect()
    free = Z.gaps(ranges, totals).select("book_id", "start_idx", "end_idx").collect()
    total = {r.book_id: r.total for r in totals.collect()}
    for book, n in total.items():
        cells = [i for r in merged + free if r.book_id == book for i in range(r.start_idx, r.end_idx)]
        assert sorted(cells) == list(range(n))


def test_fragments_never_overlap(spark):
    rng = random.Random(4)
    rows = [(str(k % 30), k, k % 2, s, s + rng.randint(0, 6)) for k in range(300) for s in [rng.randint(0, 20)]]
    kept = Z.normalize_fragments(spark.createDataFrame(rows, "book_id string, pos int, ch_idx int, start_idx int, end_idx int")).where("is_kept").collect()
    ends = {}
    for r in sorted(kept, key=lambda r: r.pos):
        assert r.start_idx >= ends.get((r.book_id, r.ch_idx), 0) and r.end_idx > r.start_idx
        ends[r.book_id, r.ch_idx] = r.end_idx


def test_book_archives(spark):
    pages = [("b", 0, "Prólogo\nUn Comienzo\nEra de noche y hacía mucho frío en la vieja ciudad de piedra, donde nadie hablaba ya de nada importante."), ("b", 1, "Capítulo 1\nLa noche seguía y la ciudad dormía bajo la lluvia mientras los barcos cruzaban el río y nadie miraba ya hacia el puerto viejo.")]
    images = spark.createDataFrame([("b", 1, 0, "i.jpg", False, "pie")], "book_id string, page_idx int, img_no int, name string, is_full_page boolean, caption string")
    row = build(spark.createDataFrame(pages, "book_id string, page_idx int, raw_text string"), images).first()
    with zipfile.ZipFile(BytesIO(row.archive)) as file:
        names = file.namelist()
        text = file.read("OEBPS/Text/001.xhtml").decode() + file.read("OEBPS/Text/002.xhtml").decode()
    assert names[0] == "mimetype" and "Un Comienzo" in text and "i.jpg" in text and "Capítulo 1" in text


def test_archives_are_whole(spark):
    words = "la ciudad dormía bajo la lluvia mientras los barcos cruzaban el río y nadie miraba ya hacia el puerto viejo"
    pages = [("b", 0, ""), ("b", 1, ""), ("b", 2, ""), ("b", 3, ""), ("b", 4, f"Capítulo 1\nPrimero {words}."), ("b", 5, f"Segundo {words}."), ("b", 6, ""), ("b", 7, f"Tercero {words}."), ("c", 0, "Solo una página."), ("d", 0, "")]
    pics = [("b", 0, 0, "cover.png", True, ""), ("b", 1, 0, "p1.jpg", True, ""), ("b", 2, 0, "p2.jpg", True, "Pie & dos"), ("b", 3, 0, "in.jpg", False, "fuera"), ("b", 5, 0, "five.jpg", False, ""), ("b", 6, 0, "six.jpg", True, ""), ("d", 0, 0, "d1.jpg", True, ""), ("d", 9, 1, "d2.jpg", True, "")]
    images = spark.createDataFrame([(*r, bytearray(r[3].encode() * 9), 600, 800) for r in pics], "book_id string, page_idx int, img_no int, name string, is_full_page boolean, caption string, content binary, width int, height int")
    books = spark.createDataFrame([("b", "Mi <Libro>", "Ana")], "book_id string, title string, author string")
    found = {r.book_id: zipfile.ZipFile(BytesIO(r.archive)) for r in build(spark.createDataFrame(pages, "book_id string, page_idx int, raw_text string"), images, books=books).collect()}
    assert sorted(found) == ["b", "c", "d"]
    for book, file in found.items():
        names = file.namelist()
        assert len(names) == len(set(names)) and names[0] == "mimetype" and file.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        opf = ElementTree.fromstring(file.read("OEBPS/content.opf").decode().encode())
        hrefs = {x.get("id"): x.get("href") for x in opf.iter("{http://www.idpf.org/2007/opf}item")}
        assert sorted([*(f"OEBPS/{h}" for h in hrefs.values()), "OEBPS/content.opf", "mimetype", "META-INF/container.xml"]) == sorted(names)
        assert all(x.get("idref") in hrefs for x in opf.iter("{http://www.idpf.org/2007/opf}itemref"))
        ncx = ElementTree.fromstring(file.read("OEBPS/toc.ncx").decode().encode())
        assert all(f"OEBPS/{x.get('src')}" in names for x in ncx.iter("{http://www.daisy.org/z3986/2005/ncx/}content"))
        shown = "".join(file.read(n).decode() for n in names if n.startswith("OEBPS/Text/"))
        for _, _, _, name, *_ in (r for r in pics if r[0] == book):
            assert file.read(f"OEBPS/Images/{name}") == name.encode() * 9
            assert shown.count(f"../Images/{name}\"") == (0 if name in ("cover.png", "d1.jpg") else 1), name
    text = [found["b"].read(n).decode() for n in found["b"].namelist() if "OEBPS/Text/0" in n]
    assert found["b"].read("OEBPS/Images/cover.jpg") == b"cover.png" * 9 and "cover.jpg" in found["b"].read("OEBPS/Text/Portada.xhtml").decode()
    assert all("".join(text).count(w) == 1 for w in ("Primero", "Segundo", "Tercero", "five.jpg"))
    assert "Mi &lt;Libro&gt;" in found["b"].read("OEBPS/content.opf").decode() and "p1.jpg" in (pair := found["b"].read("OEBPS/Text/img_001.xhtml").decode()) and "p2.jpg" in pair and "Pie &amp; dos" in pair
    assert "Solo una página." in found["c"].read("OEBPS/Text/001.xhtml").decode()


def test_config_order():
    found = config.load('{"ocr_psm": 6, "ocr_mode": "force", "other": 1}', {"ocr_mode": "auto", "lang": None})
    assert (found.ocr_psm, found.ocr_mode, found.lang) == (6, "auto", "es")


def test_decoder_errors_are_rows(spark):
    files = spark.createDataFrame([("a", bytearray(b"x|y")), ("b", bytearray(b""))], "path string, content binary")

    def decode(data):
        if not data:
            raise ValueError("empty")
        return data.decode().split("|"), "T", "A"

    rows = {(r.book_id, r.page_idx, r.raw_text, r.error) for r in books.read_pages(files, decode).collect()}
    assert rows == {("a", 0, "x", None), ("a", 1, "y", None), ("b", None, None, "empty")}


def test_landing_folder(spark, tmp_path):
    spark.createDataFrame([("b", 0, "hola\nadiós")], "book_id string, page_idx int, raw_text string").write.parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), L.page_lines).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cleaning_stays_out_of_python(spark):
    frame = spark.createDataFrame([("b", 0, "x")], "book_id string, page_idx int, raw_text string")
    plan = L.paragraphs(L.clean_lines(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_gaps_end_at_the_total(spark):
    """Empty ranges split no gap, ranges beyond the total make none, and one that reaches over it ends the last."""
    ranges = spark.createDataFrame([("b", 0, 2, 4), ("b", 0, 7, 7), ("b", 0, 20, 25), ("b", 1, 8, 30), ("b", 2, 5, 5)], "book_id string, ch_idx int, start_idx int, end_idx int")
    totals = spark.createDataFrame([("b", 0, 10), ("b", 1, 9), ("b", 2, 0), ("b", 3, 3)], "book_id string, ch_idx int, total int")
    got = sorted(tuple(r) for r in Z.gaps(ranges, totals).select("ch_idx", "start_idx", "end_idx").collect())
    assert got == [(0, 0, 2), (0, 4, 10), (1, 0, 8), (3, 0, 3)]


def test_orders_without_a_date_stay_apart(spark, tmp_path):
    import duckdb

    from folioloom.queries.structure import ORDER_SQL, order_intervals

    rows = [(1, None), (1, None), (1, "2020-01-01"), (1, "2020-01-20"), (1, "2020-06-01"), (2, None), (None, "2020-01-01"), (None, None), (None, None)]
    spark.createDataFrame(rows, "o_custkey long, d string").selectExpr("o_custkey", "cast(d as timestamp_ntz) as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = sorted(map(repr, map(tuple, order_intervals(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, duck.sql(ORDER_SQL).fetchall())) and len(got) == 8

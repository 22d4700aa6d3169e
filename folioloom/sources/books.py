"""Files as books: Spark reads the bytes, a decoder that the caller gives makes pages of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A decoder gives (page texts, title, author) of a file's bytes.
Decoder = Callable[[bytes], tuple[list[str], str, str]]


def decode_pdf(data: bytes) -> tuple[list[str], str, str]:
    """With pypdf, where it is installed."""
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    said = reader.metadata or {}
    return [page.extract_text() or "" for page in reader.pages], (said.get("/Title") or "").strip(), (said.get("/Author") or "").strip()


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_pages(files: DataFrame, decoder: Decoder = decode_pdf) -> DataFrame:
    """(book_id, page_idx, raw_text, title, author, error) of files (path, content); a file that can't be read is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    pages, title, author = decoder(content)
                    rows += [(path, i, text, title, author, None) for i, text in enumerate(pages)]
                except Exception as error:
                    rows.append((path, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["book_id", "page_idx", "raw_text", "title", "author", "error"]).astype({"page_idx": "Int32"})

    return files.mapInPandas(run, "book_id string, page_idx int, raw_text string, title string, author string, error string")


def metadata(pages: DataFrame) -> DataFrame:
    """(book_id, n_pages, title, author): counts and names without the texts."""
    return pages.where("error is null").groupBy("book_id").agg(F.count("*").alias("n_pages"), F.first("title").alias("title"), F.first("author").alias("author"))


def recognize(pages: DataFrame, images: DataFrame, engine: Callable[[bytes], str], must: F.Column) -> DataFrame:
    """pages with the engine's text where `must` holds and it reads some, and whether it did (is_read); images: (book_id, page_idx, png)."""
    wanted = pages.where(must).select("book_id", "page_idx").join(images, ["book_id", "page_idx"]).repartition("book_id", "page_idx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for png in frame["png"]:
                try:
                    texts.append(engine(png))
                except Exception:
                    texts.append(None)
            yield frame[["book_id", "page_idx"]].assign(read=texts)

    read = wanted.mapInPandas(run, "book_id string, page_idx int, read string")
    out = pages.join(read, ["book_id", "page_idx"], "left")
    read = F.nullif("read", F.lit(""))
    return out.withColumns({"raw_text": F.coalesce(read, "raw_text"), "is_read": read.isNotNull()}).drop("read")

"""Recognition of pages by an engine that is kept for each worker, under a time limit, with errors as a column.

The engine runs in a process of its own beside the worker: one that doesn't
answer in time is ended and started anew for the next page, so that a stuck page
costs its limit and no other page.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A factory makes the engine once for each process; the engine reads a picture's bytes.
Factory = Callable[[], Callable[[bytes], str]]


def _serve(line: Connection, factory: Factory) -> None:
    try:
        engine = factory()
    except Exception as error:
        broken = f"{type(error).__name__}: {error}"

        def engine(_: bytes) -> str:
            raise RuntimeError(f"no engine ({broken})")

    while True:
        try:
            data = line.recv_bytes()
        except EOFError:
            return
        try:
            line.send((engine(data), None))
        except Exception as error:
            line.send((None, f"{type(error).__name__}: {error}"))


class Guarded:
    """An engine in a process of its own; read() gives (text, None) or (None, error)."""

    def __init__(self, factory: Factory, seconds: float):
        self.factory, self.seconds, self.process = factory, seconds, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.line, there = context.Pipe()
        self.process = context.Process(target=_serve, args=(there, self.factory), daemon=True)
        self.process.start()
        there.close()

    def stop(self) -> None:
        if self.process:
            self.line.close()
            self.process.kill()
            self.process.join()
            self.process = None

    def read(self, data: bytes) -> tuple[str | None, str | None]:
        if not self.process:
            self._start()
        try:
            self.line.send_bytes(data)
            if self.line.poll(self.seconds):
                return self.line.recv()
            error = f"no answer in {self.seconds:g} s"
        except (EOFError, OSError):
            error = "the engine's process ended"
        self.stop()
        return None, error


def recognized(pages: DataFrame, images: DataFrame, factory: Factory, decision: Column, seconds: float = 60.0) -> DataFrame:
    """pages with what the engine reads in place of raw_text; is_read, ocr_reason and ocr_error.

    decision: struct<must_ocr, reason, ...> of a page; images (book_id, page_idx,
    png).  Text is replaced where the engine reads any besides blanks; a page
    without a picture, of which nothing is read, or whose engine fails keeps its
    own, and the last two say so in ocr_error.  Of several pictures of a page the
    first in byte order is read.
    """
    told = pages.withColumn("__d", decision)
    wanted = told.where("__d.must_ocr").select("book_id", "page_idx").distinct()
    first = images.groupBy("book_id", "page_idx").agg(F.min("png").alias("png"))
    wanted = wanted.join(first, ["book_id", "page_idx"]).repartition("book_id", "page_idx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = Guarded(factory, seconds)
        try:
            for frame in frames:
                got = [engine.read(bytes(png or b"")) for png in frame["png"]]
                yield frame[["book_id", "page_idx"]].assign(__read=[(text or "").strip() or None for text, _ in got], ocr_error=[error or (None if (text or "").strip() else "nothing read") for text, error in got])
        finally:
            engine.stop()

    read = wanted.mapInPandas(run, "book_id string, page_idx int, __read string, ocr_error string")
    out = told.join(read, ["book_id", "page_idx"], "left")
    is_read = F.col("__read").isNotNull()
    return out.select(*pages.columns, "__d", "__read", "ocr_error").withColumns({"raw_text": F.coalesce("__read", "raw_text"), "is_read": is_read, "ocr_reason": F.when(is_read, F.col("__d.reason"))}).drop("__d", "__read")


def recognition_report(pages: DataFrame) -> DataFrame:
    """(book_id, n_read, n_failed, reasons) of recognized pages; reasons: a map from page number to why it was read."""
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("is_read"), F.struct("page_idx", "ocr_reason")))))
    return pages.groupBy("book_id").agg(F.count_if("is_read").alias("n_read"), F.count("ocr_error").alias("n_failed"), reasons.alias("reasons"))

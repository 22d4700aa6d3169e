"""Media columns: interleaved document sequences.

HTML is parsed to an ordered array of items: texts, and references to media by
digest with their captions.  A store holds each medium once, under the digest
of its stored form, bytes included.  The digest join resolves references to
these bytes; positions and captions stay with their items.  The store is written
bucketed by digest, so the join shuffles references but not payloads.

A payload is stored as 8-bit mono samples in a WAV file, padded with zero bytes
to a positive multiple of 64.

Null html: no items.  A reference without a stored medium keeps its place with
nulls.  Null text: an empty payload.  Repeated rows share one medium.  Clashing
columns of the pages are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, batches, mapped, shuffle_partitions

UNIT, RATE = 64, 8000
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))


def encode(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of the payload and its padding."""
    data = payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(data), b"WAVE") + form + struct.pack("<4sI", b"data", len(data)) + data


def decode(media: bytes) -> bytes:
    """The samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at = 12
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(samples: bytes) -> str:
    """Samples, mean and deviation from the middle, peak, crossings of the middle, and the fullest of 16 equal ranges of values."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    ranges = np.bincount((x + 128) >> 4, minlength=16)
    return f"{len(x)}:{x.mean():.4f}:{x.std():.4f}:{int(np.abs(x).max())}:{crossings}:{int(ranges.argmax())}"


class _Items(HTMLParser):
    """Collects texts and references in document order.

    A figcaption goes to the first reference of its figure, wherever it stands in
    it; of a figure without one it is a text in its place.  A figure's end, or the
    page's, ends a caption that was left open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.silent = 0
        #: Of each open figure: its first reference, its captions (place, texts), and whether one is open.
        self.figures: list[dict] = []

    def add(self, kind: str, text: str, digest: str | None = None) -> dict:
        self.items.append({"kind": kind, "text": text, "digest": digest})
        return self.items[-1]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "figure":
            self.figures.append({"media": None, "captions": [], "open": False})
        elif tag == "figcaption" and self.figures:
            self.figures[-1]["open"] = True
            self.figures[-1]["captions"].append((len(self.items), []))
        elif tag in ("img", "audio", "video", "source"):
            said = dict(attrs)
            where = said.get("src") or ""
            if where or tag == "img":
                found = self.add("media", said.get("alt") or "", where[len(SCHEME) :] if where.startswith(SCHEME) else where)
                if self.figures and self.figures[-1]["media"] is None:
                    self.figures[-1]["media"] = found

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.figures:
            self.figures[-1]["open"] = False
        elif tag == "figure" and self.figures:
            self.end_figure()

    def end_figure(self) -> None:
        figure = self.figures.pop()
        for place, texts in reversed(figure["captions"]):
            text = " ".join(texts)
            if text and figure["media"] is None:
                self.items.insert(place, {"kind": "text", "text": text, "digest": None})
        if figure["media"] is not None:
            own = figure["media"]["text"]
            figure["media"]["text"] = " ".join(filter(None, [own, *(t for _, texts in figure["captions"] for t in texts)]))

    def handle_data(self, data):
        text = data.strip()
        if not text or self.silent:
            return
        if self.figures and self.figures[-1]["open"]:
            self.figures[-1]["captions"][-1][1].append(text)
        elif self.items and self.items[-1]["kind"] == "text":
            self.items[-1]["text"] += " " + text
        else:
            self.add("text", text)


def parse(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    while parser.figures:
        parser.end_figure()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def _parsed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(x) for x in batch.column(1).to_pylist()], _ITEM)], ["page_id", "items"])


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, items) of pages (page_id, html)."""
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_parsed, f"page_id long, items {ITEMS}")


def resolve(sequence: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each item, with the columns of the store (digest, ...) for references; texts and unknown digests have nulls."""
    items = sequence.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
    return items.join(store, "digest", "left")


def _pages(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, html): for each document a page that refers to its text's stored form by digest, captioned with the text's size."""
    for batch in batches(rows, 1):
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        html = [f'<article><p>document</p><figure><img src="{SCHEME}{hashlib.sha256(encode(x)).hexdigest()}"><figcaption>{len(x)}</figcaption></figure></article>' for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string())], ["page_id", "html"])


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, packed): the stored form of each text, compressed for the shuffle, once a task."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=9).compress
    seen: set[str] = set()
    for batch in batches(rows, 1):
        digests, packed = [], []
        for x in batch.column(1).to_pylist():
            media = encode(x or b"")
            if (digest := hashlib.sha256(media).hexdigest()) not in seen:
                seen.add(digest), digests.append(digest), packed.append(squeeze(media))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(packed, pa.binary())], ["digest", "packed"])


def _once(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, media), each digest once; all rows of a digest are in the task."""
    import zstandard

    spread = zstandard.ZstdDecompressor().decompress
    seen: set[str] = set()
    for batch in batches(rows, 1):
        digests, media = [], []
        for digest, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if digest not in seen:
                seen.add(digest), digests.append(digest), media.append(spread(packed))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


def media_store(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """(digest, media): the stored forms of the texts of docs (doc_id, text), written once a digest and bucketed by it."""
    n = shuffle_partitions(docs.sparkSession)
    packed = mapped(docs, _packed, "digest string, packed binary")
    return shelf.put_bucketed(mapped(packed.repartition(n, "digest"), _once, "digest string, media binary"), n, "digest")


_FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, position int"


def _facts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the resolved bytes of (doc_id, n_bytes, position, digest, media) say when read back; nulls without bytes."""
    for batch in rows:
        out: list[list] = [[] for _ in range(6)]
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
            if media is None:
                said = (None, None, None, None, digest, None)
            else:
                samples = decode(media)
                said = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            for column, v in zip(out, said):
                column.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds)), batch.column("position")]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FACTS.split(", ")])


def document_media(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) as a page with its text as a medium, captioned with its size, and resolved: facts of the bytes that the digest join brings."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    store = media_store(docs, Shelf(docs.sparkSession))
    pages = mapped(docs, _pages, "page_id long, html string")
    found = resolve(sequences(pages), store).where("kind = 'media'")
    return found.select(F.col("page_id").alias("doc_id"), F.col("text").cast("long").alias("n_bytes"), "position", "digest", "media").mapInArrow(_facts, _FACTS)

"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into pieces of the full length and
then of the binary digits of the rest, largest first.  Every piece is a whole
training sequence of a power-of-two length, put in the bucket of its length:
no sequence crosses documents, none is padded, and a batch takes sequences of
one bucket.  Each document is cut by itself, so nothing is shuffled.

The tokenizer splits at spaces and line feeds before anything else, so the ids
of a text are those of its runs between them.  A run of Latin letters and then
marks is split between the two, so only the lower-case words and the marks are
encoded and remembered; other runs go through the whole tokenizer.  A batch's
runs are told apart and put together by Arrow (test_documents.py holds this
against whole texts).

Null or empty text: the end id alone, one piece of length 1.  Null doc_id is
kept.  Repeated rows are packed each by itself.  Columns beside doc_id and text
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mapped
from .token_counts import byte_letters
from .worker import kept

#: Words, marks and other runs that a worker remembers; beyond that it starts anew.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
#: Bytes of text whose runs are learned together.
TEXT_BYTES = 4_000_000
END_ID = 1

#: Latin letters, then ASCII marks without the apostrophe: the tokenizer splits such a run between the two and nowhere else.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_PLAIN = f"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<mark>{_MARKS}*)$"
_PART = re.compile(f"[a-zß-öø-ÿ]+|{_MARKS}+").fullmatch
_LETTERS = str.maketrans({k: x for k, x in enumerate(byte_letters()) if k != 0x20})


class Ids:
    """Ids of texts by one tokenizer, little-endian unsigned 32-bit, each text's with the end id."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends[[k for x, k in self.tokenizer.get_vocab().items() if suffix and x.endswith(suffix)]] = True
        # Line feeds become spaces, so the run of one is the mark of a text's end.
        self.first = {"": b"", "\n": np.asarray([end_id], "<u4").tobytes()}
        self.known: dict[str, bytes] = dict(self.first)

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-case Latin words and of ASCII marks, by the tokenizer's model: nothing is left to normalize or split."""
        letters = " ".join(parts)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_LETTERS)
        ids = np.asarray(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        if len(at) != len(parts) + 1 or at[-1] != 4 * len(ids):  # a model without tokens for the ends of words
            return [np.asarray([t.id for t in self.model.model.tokenize(x)], "<u4").tobytes() for x in letters.split(" ")]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def runs(self, runs: list[str]) -> list[bytes]:
        """Ids of any runs, by the whole tokenizer."""
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def looked_up(self, keys: pa.Array) -> pa.Array:
        """Ids of parts and of runs that aren't made of such; those that are new are learned."""
        coded = keys.dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ")
        if len(self.known) > REMEMBERED:
            self.known = dict(self.first)
        found = list(map(self.known.get, names))
        new, other = [], []
        for k, x in enumerate(found):
            if x is None:
                (new if _PART(names[k]) else other).append(k)
        for learn, places in ((self.parts, new), (self.runs, other)):
            for at in range(0, len(places), 4096):
                part = places[at : at + 4096]
                for k, x in zip(part, learn([names[k] for k in part])):
                    found[k] = x
                    if len(names[k]) <= LONGEST_REMEMBERED:
                        self.known[names[k]] = x
        return pa.array(found, pa.binary()).take(coded.indices)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
        """Where each text's ids start and the last one's end, in ids, and the ids of all texts, one after another."""
        runs = pc.split_pattern(pc.binary_join_element_wise(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), "\n", " "), " ")
        coded = runs.flatten().dictionary_encode()
        plain = pc.extract_regex(coded.dictionary, _PLAIN)
        words = self.looked_up(pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "word")), coded.dictionary))
        marks = self.looked_up(pc.fill_null(pc.struct_field(plain, "mark"), ""))
        _, places, ids = pc.binary_join_element_wise(words, marks, b"").take(coded.indices).buffers()
        return np.frombuffer(places, np.int32)[runs.offsets.to_numpy()] // 4, ids


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; limit: a power of two."""
    out = [(at, limit) for at in range(0, n - limit + 1, limit)]
    at, rest = n - n % limit, n % limit
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def _pieces(path: str, limit: int, end_id: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept(f"ids:{path}:{end_id}", lambda: Ids(path, end_id))
        for batch in batches(rows, 1, TEXT_BYTES):
            owner, start, length, total = [], [], [], []
            at, ids = ids_of.of(batch.column(1))
            for k, n in enumerate(np.diff(at).tolist()):
                for first, size in cuts(n, limit):
                    owner.append(k), start.append(first), length.append(size), total.append(n)
            # Pieces follow each other as their ids do.
            places = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(places), ids]), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )
        pa.default_memory_pool().release_unused()  # an idle worker holds none

    return run


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket) of all rows of docs (doc_id, text).

    path: a tokenizer file that executors can read.  bucket: log2 of the length.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = mapped(docs, _pieces(path, limit, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences of pack() with those of one length in one folder (bucket=...), from which batches of equal lengths are read; nothing is shuffled."""
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)

"""MinHash near-dedup with HyperMinHash registers.

A document's set is that of its distinct word shingles, as 64-bit hashes.  A
signature has 256 registers; each keeps, of the least hash in its bucket, the
count of leading zeros (4 bits) and the 12 mantissa bits after the first one.
The buckets of one hash function number 1 to 256 by the size of the set (8
hashes a bucket, about), and 256 / buckets functions fill the registers, so
that small sets have no empty ones.  Sets within the wanted similarity differ
in size by a bounded factor, so a set near a change of the number of buckets
signs for both.  Bands of 5 compressed registers are the keys of candidates.

Pairs are never listed within a group of copies: equal sets are one class from
the start; each key's members are then tested against its least member of about
their size.  Only documents of keys whose members connected components leave in
different components go on: an exact prefix filter with positional bounds pairs
those of different components.  Estimates corrected for collisions drop pairs
that are far below the threshold; the rest are confirmed on full sets.  A pair
at exactly 0.8 shares no band with a probability of 2e-9.

Null text, empty text and text without words: no shingles, linked with
nothing.  Null doc_id: the row stays alone, component null and kept.  Rows with
one doc_id are one node.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, batches, mapped, small_enough
from .graph import components
from .shingles import _ODD, Hasher, mix
from .worker import kept

REGISTERS, WIDTH, MANTISSA, MOST_ZEROS = 256, 5, 12, 14
BANDS = REGISTERS // WIDTH
#: At most so many document ids are broadcast (up to 67 bytes each as a hash table); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Sizes of sets in one class differ by less than this factor; pairs are sought class by class.
STEP = 1.02

_RNG = np.random.Generator(np.random.PCG64(7))
_SALT = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64)
_FACTOR = _RNG.integers(1, 2**62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets_for(n: int) -> int:
    return 1 << min(8, max(0, n.bit_length() - 4))


def registers(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The compressed registers, uint16; 0: empty."""
    functions, bits = REGISTERS // buckets, buckets.bit_length() - 1
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    step = max(1, 65536 // functions)
    base = (np.arange(functions, dtype=np.int64) * buckets)[:, None]
    for at in range(0, len(hashes), step):
        v = (hashes[None, at : at + step] ^ _SALT[:functions, None]) * _FACTOR[:functions, None]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9FB21C651E98DF25)
        v ^= v >> np.uint64(29)
        if buckets == 1:
            np.minimum(least, v.min(axis=1), out=least)
        else:
            slot = base + (v >> np.uint64(64 - bits)).astype(np.int64)
            np.minimum.at(least, slot.ravel(), (v << np.uint64(bits)).ravel())
    empty = least == np.uint64(2**64 - 1)
    zeros = np.minimum(64 - np.frexp(np.maximum(least, 1).astype(np.float64))[1], MOST_ZEROS)
    zeros = np.maximum(zeros, 0)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    value = 1 + (zeros.astype(np.uint64) << np.uint64(MANTISSA)) + mantissa
    return np.where(empty, 0, value).astype(np.uint16)


def band_keys(sign: np.ndarray, buckets: int) -> np.ndarray:
    rows = sign[: BANDS * WIDTH].reshape(BANDS, WIDTH).astype(np.uint64)
    keys = mix((rows * _ODD[:WIDTH]).sum(axis=1, dtype=np.uint64) + (np.arange(BANDS, dtype=np.uint64) * np.uint64(16) + np.uint64(buckets.bit_length())) * _ODD[WIDTH])
    return keys[rows.any(axis=1)].view(np.int64)


def chance(n: int, m: int, buckets: int) -> float:
    """The share of registers that agree by chance, of two disjoint sets of n and m."""
    j = np.arange(MOST_ZEROS + 1)
    low, high = np.exp2(-(j + 1.0)), np.exp2(-j.astype(float))
    low[-1] = 0.0
    p, q = ((1 - low) ** (x / buckets) - (1 - high) ** (x / buckets) for x in (n, m))
    return float((p * q).sum() / 2**MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, buckets: int) -> tuple[float, int]:
    """Jaccard similarity corrected for collisions, and the registers that it rests on."""
    used = int(((a > 0) | (b > 0)).sum())
    same = int(((a == b) & (a > 0)).sum())
    by_chance = chance(n, m, buckets)
    return (same / max(used, 1) - by_chance) / (1 - by_chance), used


def _schemes(n: int, percent: int) -> list[int]:
    return sorted({buckets_for(n), buckets_for(n * 100 // percent)})


def _sign(size: int, percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hasher = kept("hasher", Hasher)
        for batch in batches(rows, 1):
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()]
            count, digest, signs = [], [], []
            for found in hasher.sets(texts, size):
                count.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signs.append([{"buckets": m, "registers": registers(found, m).tobytes()} for m in _schemes(len(found), percent)] if len(found) else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(signs, pa.list_(pa.struct([("buckets", pa.int32()), ("registers", pa.binary())])))], ["doc_id", "n_shingles", "digest", "signs"])

    return run


def _bands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, sizes, signs = (batch.column(i).to_pylist() for i in range(3))
        keys, owner, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d, n, schemes in zip(ids, sizes, signs):
            for s in schemes:
                k = band_keys(np.frombuffer(s["registers"], np.uint16), s["buckets"])
                keys.append(k), owner.append(np.full(len(k), d, np.int64)), count.append(np.full(len(k), n, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owner, count)], ["key", "doc", "n"])


def _estimated(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            left, right = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            keep = []
            for n, m, sa, sb in zip(left, right, batch.column("signs_a").to_pylist(), batch.column("signs_b").to_pylist()):
                other = {s["buckets"]: s["registers"] for s in sb}
                ok = False
                for s in sa:
                    if s["buckets"] in other and 100 * min(n, m) >= percent * max(n, m):
                        j, used = estimate(np.frombuffer(s["registers"], np.uint16), np.frombuffer(other[s["buckets"]], np.uint16), n, m, s["buckets"])
                        ok |= j >= percent / 100 - 7 * (0.16 / max(used, 1)) ** 0.5
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _sets(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept("hasher", Hasher)
        for batch in batches(rows, 1):
            once = {*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
            out = [x.tobytes() for x in hasher.sets([t or b"" for _, t in once], size)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in once], pa.int64()), pa.array(out, pa.binary())], ["doc", "shingles"])

    return run


def _confirmed(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


class _Links:
    """Estimates and confirms candidate pairs (a, b)."""

    def __init__(self, shelf: Shelf, docs: DataFrame, signed: DataFrame, size: int, percent: int):
        self.shelf, self.docs, self.signed, self.size, self.percent = shelf, docs, signed, size, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        signs = self.signed.select(F.col("doc_id").alias("doc"), "n_shingles", "signs")
        side = lambda x: signs.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signs").alias(f"signs_{x}"))
        likely = self.shelf.put(mapped(pairs.join(side("b"), "b").join(side("a"), "a"), _estimated(self.percent), "a long, b long").distinct())
        wanted = self.shelf.put(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sets = self.shelf.put(mapped(_texts(self.docs, wanted), _sets(self.size), "doc long, shingles binary"))
        side = lambda x: sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"shingles_{x}"))
        links = self.shelf.put(mapped(likely.join(side("b"), "b").join(side("a"), "a"), _confirmed(self.percent), "a long, b long").distinct())
        for x in (likely, wanted, sets):
            self.shelf.drop(x)
        return links


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text as bytes) of the wanted doc_ids, and what columns they bring; broadcast only if they are few."""
    few = small_enough(wanted, BROADCAST_IDS)
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), *(c for c in wanted.columns if c != "doc_id"))


def _exploded(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept("hasher", Hasher)
        for batch in batches(rows, 1):
            found = [*hasher.sets([x or b"" for x in batch.column(1).to_pylist()], size)]
            count = np.array([len(x) for x in found], np.int64)
            ids, c = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), count) for i in (0, 2))
            part = np.repeat(np.array([int(np.bitwise_xor.reduce(x)) if len(x) else 0 for x in found], np.uint64).view(np.int64), count)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, c, part, np.repeat(count, count), np.concatenate(found).view(np.int64))], ["doc", "c", "part", "n", "shingle"])

    return run


def _common(n: str, m: str, percent: int) -> Column:
    """The least number of common shingles of linked sets of n and m."""
    return F.ceil((F.expr(n) + F.expr(m)) * percent / (100 + percent))


def _prefix_pairs(docs: DataFrame, of: DataFrame, shelf: Shelf, size: int, percent: int) -> DataFrame:
    """Candidates (a, b) of different components among the documents of (doc, c), by an exact prefix filter.

    Shingles of one component alone can't link two, so they stand first in each
    document's order; the others follow, rarest first.  Linked sets of n and m
    with k common shingles at least share one of the first n - k + 1 and m - k + 1
    of their orders, so a passage or a template that many documents share makes no
    candidates of those that differ in more than the threshold leaves.  Pairs are
    not listed within the largest component of a shingle: the rest of its
    documents meet all of them.
    """
    every = mapped(_texts(docs, of.withColumnRenamed("doc", "doc_id")), _exploded(size), "doc long, c long, part long, n long, shingle long")
    mixed = shelf.put(every.groupBy("shingle").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle", "df"))
    # Rows of one document that are equal count once; `part` tells different texts of one doc_id apart.
    known = every.join(mixed, "shingle").repartition("doc", "part").dropDuplicates(["doc", "part", "shingle"])
    shared = F.count("*").over(Window.partitionBy("doc", "part"))
    place = F.row_number().over(Window.partitionBy("doc", "part").orderBy("df", "shingle")) + F.col("n") - F.col("shared")
    # A pair shares at most what the poorer one has in mixed shingles; that bounds the sizes of partners from above.
    most = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")
    prefix = known.withColumn("shared", shared).withColumn("place", place).withColumn("most", most).withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100)))
    prefix = prefix.where(F.col("most") >= F.col("least")).where(F.col("place") <= F.col("n") - _common("n", "least", percent) + 1)
    prefix = shelf.put(prefix.select("shingle", "doc", "c", "n", "place", "most", "least"))

    # The longer one of a pair looks through the classes of sizes that its partner can have; the shorter one is in one of them.
    step = lambda n: F.floor(F.log(n) / float(np.log(STEP))).cast("int")
    long = prefix.withColumn("class", F.explode(F.sequence(step(F.col("least")), step(F.greatest("least", F.least("n", "most"))))))
    long = long.withColumn("from", F.greatest("least", F.floor(F.pow(F.lit(STEP), F.col("class")) * 0.999999))).where(F.col("place") <= F.col("n") - _common("n", "from", percent) + 1)
    short = prefix.where(F.col("place") <= F.col("n") - _common("n", "n", percent) + 1).withColumn("class", step(F.col("n")))
    sizes = short.groupBy("shingle", "class", "c").agg(F.count("*").alias("k"))
    sizes = shelf.put(sizes.groupBy("shingle", "class").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi")))
    a, b = (x.join(sizes, ["shingle", "class"]).select("shingle", "class", "main", "lo", "hi", *(F.col(k).alias(f"{k}_{y}") for k in ("doc", "n", "c", "most", "place"))) for x, y in ((long, "a"), (short, "b")))
    a = a.where("lo < hi or lo <> c_a")
    fits = "c_a <> c_b and (n_b < n_a or n_b = n_a and doc_b < doc_a) and n_b <= most_a and n_a <= most_b"
    near = (F.col("n_a") * percent <= F.col("n_b") * 100) & (F.least(F.expr("n_a - place_a"), F.expr("n_b - place_b")) + 1 >= _common("n_a", "n_b", percent))
    meet = lambda x, y: x.join(y.drop("main", "lo", "hi"), ["shingle", "class"]).where(fits).where(near)
    # Of the pairs within a shingle's largest component, none is made: b of others meets every a, b of the largest every a of others.
    found = meet(a, b.where("c_b <> main")).unionByName(meet(a.where("c_a <> main"), b.where("c_b = main")))
    return found.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = shelf.put(
        mapped(
            docs.select("doc_id", F.col("text").cast("binary").alias("text")),
            _sign(size, percent), "doc_id long, n_shingles long, digest binary, signs array<struct<buckets:int,registers:binary>>",
        )
    )
    linked = every.where("doc_id is not null and n_shingles > 0")
    classes = shelf.put(linked.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    signed = linked.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    signed = shelf.put(signed.select("doc_id", "n_shingles", "signs"))
    bands = shelf.put(mapped(signed.select("doc_id", "n_shingles", "signs"), _bands, "key long, doc long, n long"))
    keys = bands.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    members = shelf.put(bands.join(shelf.put(keys), "key"))
    links = _Links(shelf, docs, signed, size, percent)

    # Each member of a key is tested against the least one of about its size.
    near = F.floor(F.log("n") / float(np.log(100 / percent)) * 2)
    pivots = members.groupBy("key", near.alias("class")).agg(F.min(F.struct("doc", "n")).alias("p"), F.max("doc").alias("hi")).where("p.doc < hi")
    pivots = pivots.select(F.col("key"), "class", F.col("p.doc").alias("a"), F.col("p.n").alias("m"))
    tested = members.withColumn("class", near).join(shelf.put(pivots), ["key", "class"])
    tested = tested.where("doc <> a").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    found = links.of(shelf.put(tested.select("a", F.col("doc").alias("b")).distinct()))
    joined = components(shelf, found)
    rows = shelf.put(members.select("key", "doc").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("c")))
    mixed = shelf.put(rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    apart = shelf.put(rows.join(mixed, "key", "left_semi").select("doc", "c").distinct())
    if not apart.isEmpty():
        pairs = shelf.put(_prefix_pairs(docs, apart, shelf, size, percent).distinct())
        if not pairs.isEmpty():
            joined = components(shelf, joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.of(pairs)))

    # A class without words or id is alone; the rest follow their class's least document.
    owner = every.select("doc_id", "digest", "n_shingles")
    nodes = joined.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    roots = shelf.put(classes.join(nodes, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id")))
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    out = owner.where(~alone).join(roots, "digest").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(owner.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one document of each group: that with the least doc_id."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")

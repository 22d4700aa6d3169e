"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark window (13 words, or a shorter item as a whole) is a set of
positioned shingles of 5 words (of fewer where the window has fewer).
Containing a window means containing all its shingles, so its necessary prefix
is one: the rarest, by counts over all documents.  Document shingles are first
joined to the benchmark's; those found carry the words around them.  They are
then joined to the windows by the windows' rarest shingles, under the bounds
that the window starts and ends within the document, and the words of the whole
window are compared.

The benchmark's shingles are broadcast only when their count is below a stated
bound; beyond it, shingle positions are joined by shuffle and the words join
afterwards.  Null text has no words and no hits.  Repeated rows each get their
own result.  Null doc_id is a value like any other; a null item_id marks hits
but no item.  Columns beside doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, small_enough

#: 24 bytes each.
BROADCAST_SHINGLES = 1_000_000
WINDOW, SHINGLE = 13, 5
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS, -1), lambda w: w != "")


def _shingles(w: Column, k: int) -> Column:
    """Hashes of the shingles of k words, by position."""
    at = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at)).otherwise(F.array().cast("array<long>"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, window, length, k, offset, token): each shingle of each window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.lit(WINDOW), F.size("w"))).withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))
    w = w.select("item_id", "length", "k", F.explode(F.expr("transform(sequence(0, size(w) - length), s -> slice(w, s + 1, length))")).alias("window")).distinct()
    tokens = F.lit(None).cast("array<long>")
    for k in range(1, SHINGLE + 1):
        tokens = F.when(F.col("k") == k, _shingles(F.col("window"), k)).otherwise(tokens)
    return w.select("item_id", "window", "length", "k", F.posexplode(tokens).alias("offset", "token"))


def contamination(shelf: Shelf, docs: DataFrame, benchmark: DataFrame, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, n_words, n_hit and items (array of item ids, sorted as strings) for every row of docs, with the row's text hash `mark`."""
    windows = shelf.put(_windows(benchmark))
    tokens = shelf.put(windows.select("token").distinct())
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())
    small = small_enough(tokens, broadcast_shingles)

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words(text).alias("w"))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    found = F.concat(*(_shingles(F.col("w"), k) for k in lengths)) if len(lengths) > 1 else _shingles(F.col("w"), lengths[0] if lengths else SHINGLE)
    if len(lengths) > 1:
        place = F.concat(*(F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>")) for k in lengths))
        found = F.arrays_zip(place.alias("pos"), found.alias("token"))
        rows = lambda c: c.select("doc_id", "mark", "n_words", "w", F.explode(found).alias("f")).select("doc_id", "mark", "n_words", "w", F.col("f.pos").alias("pos"), F.col("f.token").alias("token"))
    else:
        rows = lambda c: c.select("doc_id", "mark", "n_words", "w", F.posexplode(found).alias("pos", "token"))
    first = F.greatest(F.lit(0), F.col("pos") - WINDOW)
    around = [first.alias("first"), F.slice("w", first + 1, F.lit(2 * WINDOW + SHINGLE)).alias("around")]
    if small:
        hits = rows(d).join(F.broadcast(tokens), "token").select("doc_id", "mark", "n_words", "pos", "token", *around)
    else:
        at = rows(d).select("doc_id", "mark", "pos", "token").distinct().join(tokens, "token")
        same = (F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))) & (F.col("x.mark") == F.col("y.mark"))
        hits = at.alias("x").join(d.dropDuplicates(["doc_id", "mark"]).alias("y"), same).select("y.doc_id", "y.mark", "n_words", "pos", "token", *around)
    hits = shelf.put(hits)

    counted = hits.groupBy("token").agg(F.count("*").alias("df"))
    rarest = windows.join(counted, "token").groupBy("item_id", "window", "length").agg(F.count("*").alias("present"), F.max("k").alias("k"), F.min(F.struct("df", "token", "offset")).alias("rarest"))
    rarest = rarest.where("present >= length - k + 1").select("item_id", "window", "length", "rarest.token", "rarest.offset")
    rarest = shelf.put(rarest)
    if small_enough(rarest, broadcast_shingles // 10):
        rarest = F.broadcast(rarest)
    start = F.col("pos") - F.col("offset")
    inside = hits.join(rarest, "token").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    inside = inside.where(F.slice("around", start - F.col("first") + 1, F.col("length")) == F.col("window"))
    span = F.struct(start.alias("s"), (start + F.col("length")).alias("e"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    by_doc = inside.groupBy("doc_id", "mark").agg(F.collect_set(span).alias("spans"), F.collect_set("item_id").alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), covered.alias("n_hit"), F.array_sort("items").alias("items"))
    every = d.select("doc_id", "mark", "n_words")
    out = every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    return out.select("doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    """At least a twentieth of the words, and one, lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    bad = contamination(Shelf(docs.sparkSession), docs, benchmark).where(is_contaminated())
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("mark").alias("__bad_mark"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__bad_mark"]), "left_anti")

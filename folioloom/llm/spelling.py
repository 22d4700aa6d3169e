"""Spelling variants: pairs of words one edit apart, by composing acceptors with a one-edit transducer.

Words are counted over all texts.  The vocabulary is dealt into partitions by
where an edit can be: two words whose shorter one has m code points and whose
first difference is at a place in [low, high) share the code points before low
and the last m - high.  Each word goes to two such intervals for each length m
that it can meet, under a hash of what is shared; a partition that holds more
than LIMIT words has its interval halved until it holds fewer or the interval is
one place, which the alphabet bounds.  So no pair is lost, and none is found
twice.

In a partition, minimised acceptors of the shorter and the longer words are
built, from the state that the shared beginning leads to.  The one-edit
transducer between them has two phases: before the edit both acceptors read the
same code point; the edit reads different ones, or one in the longer word alone;
after it both read the same again.  The composition is walked from the initial
state of the partition, entering only pairs of states from which both acceptors
can end with the same rest; this is found once for each pair of states.  An edit
in a run of equal code points is taken at its end, so that each accepted pair
has one path.

Null text has no words; a null doc_id counts as an empty one.  Repeated rows
count again.  Ties are broken by code point order.  Without near pairs, or
without words, the columns are null or the result is empty.  Other columns than
doc_id and text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, mapped, shuffle_partitions, small_enough

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST, OFTEN, EVERY = 5, 3, 97
#: Words in a partition before its interval is halved; hot partitions that a join may broadcast.
LIMIT, FEW = 2_000, 10_000


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the documents' words, lower-cased in A-Z, with the code points that the hash deletes left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.col("text").cast("string"), upper, upper.lower())
    runs = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{LEAST},}}"), F.lit(0))
    found = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substr("run", at + 2))
    found = found.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _dealt(rows: DataFrame, *halves: tuple[Column, Column]) -> DataFrame:
    """rows (word, n, m) once for each interval (low, high), under a key of what such pairs share."""
    ends = F.explode(F.array(*(F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in halves)))
    out = rows.select("word", "n", "m", ends.alias("at")).select("word", "n", "m", "at.*")
    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    shared = F.xxhash64(F.substring("word", 1, F.col("low")), F.substr("word", F.length("word") - tail + 1, tail))
    return out.withColumn("key", shared)


_GROUP = ["m", "low", "high", "key"]


def partitions(shelf: Shelf, vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, m, low, high, key): the vocabulary in partitions of at most `limit` words, or of intervals of one place."""
    long = F.length("word")
    meets = F.explode(F.when(long > LEAST, F.array(long - 1, long)).otherwise(F.array(long)))
    rows = vocabulary.select("word", "n", meets.alias("m"))
    middle = F.ceil((F.col("m") + 1) / 2)
    rows = _dealt(rows, (F.lit(0), middle), (middle, F.col("m") + 1))
    ready = None
    while True:
        hot = shelf.put(rows.groupBy(*_GROUP).agg(F.count("*").alias("words")).where((F.col("words") > limit) & (F.col("high") - F.col("low") > 1)).select(*_GROUP))
        if hot.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        side = F.broadcast(hot) if small_enough(hot, FEW) else hot
        cool = rows.join(side, _GROUP, "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        half = F.ceil((F.col("low") + F.col("high")) / 2)
        split = rows.join(side, _GROUP, "left_semi").select("word", "n", "m", F.col("low").alias("from"), F.col("high").alias("to"), half.alias("half"))
        ends = F.array(F.struct(F.col("from").alias("a"), F.col("half").cast("int").alias("b")), F.struct(F.col("half").cast("int").alias("a"), F.col("to").alias("b")))
        split = split.select("word", "n", "m", F.explode(ends).alias("e"))
        rows = shelf.put(_dealt(split, (F.col("e.a"), F.col("e.b"))))


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words; arcs go to states of smaller numbers."""

    def __init__(self, found: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.ends: list[bool] = []
        known: dict[tuple, int] = {}
        # The path of the last word: arcs and end of each state that may still grow.
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, end = path.pop()
                path[-1][0][last[len(path) - 1]] = self._state(known, arcs, end[0])

        for word in found:
            same = len(os.path.commonprefix((last, word)))
            close(same)
            path += [({}, [False]) for _ in word[same:]]
            path[-1][1][0] = True
            last = word
        close(0)
        self.start = self._state(known, path[0][0], path[0][1][0])

    def _state(self, known: dict[tuple, int], arcs: dict[str, int], end: bool) -> int:
        form = (end, *arcs.items())
        if form not in known:
            known[form] = len(self.arcs)
            self.arcs.append(arcs)
            self.ends.append(end)
        return known[form]


class Composition:
    """Acceptor of shorter words, one edit, acceptor of longer ones (the same one for a replaced code point)."""

    def __init__(self, first: Acceptor, second: Acceptor):
        self.first, self.second = first, second
        self.alive: dict[tuple[int, int], bool] = {}

    def _live(self, p: int, q: int) -> bool:
        """Whether the two acceptors can end with the same rest from these states."""
        alive, stack = self.alive, [(p, q)]
        while stack:
            pair = stack[-1]
            if pair in alive:
                stack.pop()
                continue
            a, b = self.first.arcs[pair[0]], self.second.arcs[pair[1]]
            if self.first.ends[pair[0]] and self.second.ends[pair[1]]:
                alive[pair] = True
                continue
            if len(b) < len(a):
                next_pairs = [(a[c], b[c]) for c in b if c in a]
            else:
                next_pairs = [(a[c], b[c]) for c in a if c in b]
            if any(alive.get(x) for x in next_pairs):
                alive[pair] = True
            elif waiting := [x for x in next_pairs if x not in alive]:
                stack.append(waiting[0])
            else:
                alive[pair] = False
        return alive[p, q]

    def _rests(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """All rests that both acceptors take from these states; `but` may not begin one."""
        stack = [(p, q, "")]
        while stack:
            p, q, said = stack.pop()
            if self.first.ends[p] and self.second.ends[q]:
                yield said
            b = self.second.arcs[q]
            for c, to in self.first.arcs[p].items():
                if c in b and (said or c != but) and self._live(to, b[c]):
                    stack.append((to, b[c], said + c))

    def pairs(self, low: int, high: int) -> Iterator[tuple[str, str]]:
        """(word, word) accepted with the edit at a place in [low, high)."""
        one = self.first is self.second
        stack = [(self.first.start, self.second.start, "")]
        while stack:
            p, q, said = stack.pop()
            a, b = self.first.arcs[p], self.second.arcs[q]
            if low <= len(said) < high:
                if one:
                    some = list(a.items())
                    for k, (c, to) in enumerate(some):
                        for d, other in some[k + 1 :]:
                            if self._live(to, other):
                                for rest in self._rests(to, other):
                                    yield said + c + rest, said + d + rest
                else:
                    for d, other in b.items():
                        for rest in self._rests(p, other, d):
                            yield said + rest, said + d + rest
            if len(said) + 1 < high:
                stack += [(to, b[c], said + c) for c, to in a.items() if c in b]


def near_in(shorter: list[str], longer: list[str], low: int, high: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of sorted words of m code points, and of these with sorted words of one more, edited in [low, high)."""
    if not shorter or len(shorter) + len(longer) < 2:
        return
    head = os.path.commonprefix([shorter[0], shorter[-1], *longer[:1], *longer[-1:]])
    base = len(head)
    bare = lambda rows: [w[base:] for w in rows]
    first = Acceptor(bare(shorter))
    for second in (first, Acceptor(bare(longer))) if longer else (first,):
        for a, b in Composition(first, second).pairs(low - base, high - base):
            yield head + a, head + b


def near_pairs(dealt: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all words one edit apart, in both directions."""
    rows = dealt.repartition(shuffle_partitions(dealt.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP, "word")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts = None, {}
        out: list[tuple[str, int, str, int]] = []

        def pairs() -> Iterator[tuple[str, int, str, int]]:
            m, low, high, _ = group
            shorter, longer = [w for w in counts if len(w) == m], [w for w in counts if len(w) > m]
            for a, b in near_in(shorter, longer, low, high):
                yield a, counts[a], b, counts[b]
                yield b, counts[b], a, counts[a]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])

        for part in found:
            for *key, word, n in zip(*(c.to_pylist() for c in part.columns)):
                if key != group:
                    if len(counts) > 1:
                        for pair in pairs():
                            out.append(pair)
                            if len(out) >= 10_000:
                                yield batch()
                    group, counts = key, {}
                counts[word] = n
        if len(counts) > 1:
            for pair in pairs():
                out.append(pair)
                if len(out) >= 10_000:
                    yield batch()
        if out:
            yield batch()

    return mapped(rows.select(*_GROUP, "word", "n"), run, "word string, n long, near string, near_n long")


def _roots(shelf: Shelf, forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms are followed to the last, twice as far in each step; counts at least double, so steps are few."""
    step = shelf.put(forms.select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = shelf.put(step.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        shelf.drop(step)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        step = shelf.put(new.drop("moved"))
        shelf.drop(new)


def variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the documents' words."""
    shelf = Shelf(docs.sparkSession)
    vocabulary = shelf.put(words(docs))
    near = near_pairs(partitions(shelf, vocabulary, limit))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("best.less") + 2 * F.col("n") <= 0
    rows = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    rows = shelf.put(rows)
    roots = _roots(shelf, rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))

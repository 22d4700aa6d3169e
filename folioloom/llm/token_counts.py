"""Exact token counts of every prefix of a text under byte-level BPE, by dynamic programming.

Within a pretoken, each prefix has one last token: the only vocabulary entry
ending there that byte-pair encoding keeps apart from the last token before it
(two tokens stay apart if encoding both together gives them back).  So the
count at a prefix is the count where its last token starts, plus one, and a
table of these counts answers any cut of the pretoken.  Tables are kept per
pretoken; a text's count is the sum of its pretokens' last entries, and a
budget's cut is found in the running sum and one table, without encoding again.

Null text: empty, no tokens.  Null doc_id and repeated rows are kept as they
are.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mapped
from .worker import kept

REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
UNMERGED = 1 << 60
#: Spaces at an end or next to other white space, where a run between spaces is not split by itself.
_LOOSE = re.compile(r"\s\s|^\s|\s\Z|[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in vocabularies of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounts(dict):
    """Pretoken -> the token counts of its byte prefixes from length 0 on, one byte each."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.split = regex.compile(pattern).findall
        self.leading, self.blank = regex.compile(r"\s*").match, regex.compile(r"\s+").fullmatch
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})
        self.special = [x["content"] for x in said["added_tokens"] if x["special"]]
        self.between = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).finditer if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.tokens = {*byte_letters(), *("".join(m) for m in merges)} & said["model"]["vocab"].keys()
        self.longest = max(map(len, self.tokens))
        self.made = {"".join(m): (i, m) for i, m in reversed([*enumerate(merges)])}
        self.spines = [lru_cache(None)(partial(self.spine, right=x)) for x in (True, False)]
        self.apart: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, int] = {}

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts along the right or left edge of a token's merges, from the byte up, each with the rank of the merge that takes it in."""
        out = [(token, UNMERGED)]
        while len(token) > 1:
            rank, parts = self.made[token]
            token = parts[right]
            out.append((token, rank))
        return out[::-1]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses from a to b before both are whole; of equal merges the left one comes first."""
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 2 * REMEMBERED:
                self.apart.clear()
            left, right, rank = self.spines[0](a), self.spines[1](b), self.rank
            i = j = 0
            found = True
            while True:
                (x, x_rank), (y, y_rank) = left[i], right[j]
                across = rank.get((x, y), UNMERGED)
                if across < x_rank and across <= y_rank and across < UNMERGED:
                    found = False
                    break
                if x_rank == y_rank == UNMERGED:
                    break
                if x_rank <= y_rank:
                    i += 1
                else:
                    j += 1
            self.apart[a, b] = found
        return found

    def table(self, pretoken: str) -> list[int]:
        text = pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        count, last = [0], [""]
        tokens, apart, longest = self.tokens, self.stay_apart, self.longest
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                token = text[start:end]
                if token in tokens and (not start or apart(last[start], token)):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def __missing__(self, pretoken: str) -> bytes | list[int]:
        found = self.table(pretoken)
        if len(pretoken) > LONGEST_REMEMBERED or max(found) > 255:
            return found
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[pretoken] = bytes(found)
        return out

    def pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(characters of a special token before it, the pretokens) of each part of the text between special tokens."""
        at = mark = 0
        for m in self.between(text) if self.between else ():
            yield mark, self.split(text[at : m.start()])
            at, mark = m.end(), m.end() - m.start()
        yield mark, self.split(text[at:])

    def run_count(self, run: str) -> int:
        total = sum([self[x][-1] for x in self.split(" " + run)])
        if len(run) <= LONGEST_REMEMBERED:
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            self.runs[run] = total
        return total

    def count(self, text: str) -> int:
        """A run between single spaces, with the space before it, is split by itself, so its sum is kept too."""
        if any(x in text for x in self.special) or _LOOSE(text):
            total = 0
            for k, (_, pretokens) in enumerate(self.pieces(text)):
                total += (k > 0) + sum([self[x][-1] for x in pretokens])
            return total
        if not text:
            return 0
        first, *rest = text.split(" ")
        found = [*map(self.runs.get, rest)]
        if None in found:
            found = [self.run_count(run) if n is None else n for run, n in zip(rest, found)]
        return sum(self[x][-1] for x in self.split(first)) + sum(found)

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of text[:i], for every i; a special token cut short is the plain text that it then is."""
        out, base, at = [0], 0, 0
        for m in self.between(text) if self.between else ():
            plain = self.plain_counts(text[at : m.end() - 1])
            out += [base + x for x in plain[1:]]
            short = m.group()[:-1]
            if any(x in short for x in self.special):  # cut short, it holds another special token
                for i in range(m.start() + 1, m.end()):
                    out[i] = self.count(text[:i])
            base += plain[m.start() - at] + 1
            out.append(base)
            at = m.end()
        return out + [base + x for x in self.plain_counts(text[at:])[1:]]

    def plain_counts(self, text: str) -> list[int]:
        """The token count of text[:i], for every i, of a text without special tokens."""
        out, base, at = [0], 0, 0
        pretokens = self.split(text)
        for k, pretoken in enumerate(pretokens):
            counts = self[pretoken]
            ends = list(accumulate(len(c.encode()) for c in pretoken))
            inside = [counts[e] for e in ends]
            if pretoken in ("'re", "'ve", "'ll"):
                inside[1] = self[pretoken[0]][-1] + self[pretoken[1]][-1]
            out += [base + x for x in inside]
            # A cut within or just after white space leaves the whole run as one pretoken.
            spaces = len(self.leading(pretoken)[0])
            if spaces and k and self.blank(pretokens[k - 1]):
                run, j = pretoken[:spaces], k - 1
                before = 0
                while j >= 0 and self.blank(pretokens[j]):
                    run = pretokens[j] + run
                    before += self[pretokens[j]][-1]
                    j -= 1
                whole = self[run]
                out[at + spaces] = base - before + whole[-1]
            base += counts[-1]
            at += len(pretoken)
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of a prefix of at most budget tokens that ends where the first pretoken or special token beyond it no longer fits."""
        total = at = 0
        for k, (mark, pretokens) in enumerate(self.pieces(text)):
            if k:
                if total + 1 > budget:
                    return at
                total, at = total + 1, at + mark
            for pretoken in pretokens:
                counts = self[pretoken]
                if total + counts[-1] > budget:
                    ends = list(accumulate(len(c.encode()) for c in pretoken))
                    return at + max((i + 1 for i, e in enumerate(ends) if total + counts[e] <= budget), default=0)
                total, at = total + counts[-1], at + len(pretoken)
        return at


def _counts(path: str, pattern: str, budget: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kept("prefix:" + path, lambda: PrefixCounts(path, pattern))
        for batch in batches(rows, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [tables.count(x) for x in texts]
            cut = [len(x) if k <= budget else tables.cut(x, budget) for k, x in zip(n, texts)]
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, n, cut))], ["doc_id", "n_bytes", "n_tokens", "fits_chars"])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, budget: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and fits_chars (the characters within the budget) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(docs, _counts(path, pattern, budget), "doc_id long, n_bytes long, n_tokens long, fits_chars long")

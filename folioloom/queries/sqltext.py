"""DuckDB spellings of the text functions, for the queries' SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import text as T
from ..sources.tables import table


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{P.SPACE}]+|[{P.SPACE}]+$')}, '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(f'[{P.SPACE}]+')}, ' ', 'g')")


def heading(x: str) -> str:
    return f"regexp_replace({collapse(x)}, {q(f'^[{P.DECOR}]+|[{P.DECOR}]+$')}, '', 'g')"


def fits(x: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({x}, {q(('(?i)' if ignore_case else '') + pattern)})"


def structural(x: str) -> str:
    return fits(heading(x), P.STRUCTURAL)


def lines(x: str) -> str:
    split = f"string_split_regex({x}, {q(P.BREAK)})"
    return f"(CASE WHEN {split}[-1] = '' THEN {split}[:-2] ELSE {split} END)"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(f'[{P.SPACE}]+')}), lambda w: w <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def without_page_number(x: str) -> str:
    return f"(CASE WHEN regexp_matches({strip(x)}, '^[0-9]{{1,4}}$') THEN '' ELSE {strip(x)} END)"


def subtitle(x: str) -> str:
    """x: a heading text in a column."""
    w = words(x)
    return f"""({x} <> '' AND NOT {fits(x, P.STRUCTURAL)} AND length({x}) <= 120 AND len({w}) <= 14 AND NOT {fits(x, P.LEADERS, False)}
      AND NOT (contains({x}, '|') AND regexp_matches({x}, '[0-9]{{1,4}}$')) AND NOT regexp_matches({x}, '^[0-9]{{1,4}}$') AND NOT {fits(x, P.NO_SUBTITLE)}
      AND len(list_filter({w}, lambda v: {fits('v', P.TITLED, False)})) >= greatest(1, len({w}) // 2))"""


def header_form(x: str) -> str:
    """x: a collapsed line; adjacent numbers share an edge, so each replacement runs twice."""
    edge = rf"(^|[^{P.WORD}])"
    end = rf"($|[^{P.WORD}])"
    phrase = lambda t: f"regexp_replace({t}, {q(f'(?i){edge}(p[áa]g(?:ina)?{chr(92)}.? *)[0-9]{{1,4}}{end}')}, {q(f'{chr(92)}1{chr(92)}2<PAGE_NUM>{chr(92)}3')}, 'g')"
    marked = phrase(phrase(x))
    marked = f"(CASE WHEN {fits(marked, P.PAGE_LINE, False)} THEN regexp_replace({marked}, '[0-9]{{1,4}} *$', '<PAGE_NUM>') ELSE {marked} END)"
    number = lambda t: f"regexp_replace({t}, {q(f'{edge}[0-9]{{1,4}}{end}')}, {q(f'{chr(92)}1<PAGE_NUM>{chr(92)}2')}, 'g')"
    last = collapse(number(number(marked)))
    return f"""(CASE WHEN {x} = '' OR {structural(x)} THEN '' WHEN regexp_matches({x}, '^[\\-–— ]*[0-9]{{1,4}}[\\-–— ]*$') THEN '<PAGE_NUM>'
      WHEN {structural(last)} THEN '' ELSE {last} END)"""


def page_phrase(x: str) -> str:
    return f"({fits(x, P.PAGE_PHRASE)} OR {fits(x, P.SHORT_PAGE_PHRASE)} OR {fits(x, P.DASHED_NUMBER, False)} OR {fits(x, P.PAGE_LINE, False)})"


def toc_score(x: str) -> str:
    """x: a heading text in a column."""
    short = f"(length({x}) <= 140 AND len({words(x)}) <= 18)"
    named, leaders, pipe = fits(f"lower({x})", P.TOC_SECTIONS, False), fits(x, P.LEADERS, False), f"contains({x}, '|')"
    trailing = fits(x, rf"(^|[^{P.WORD}])[0-9]{{1,4}}$", False)
    return f"""(4 * CAST({fits(f'lower({x})', P.TOC_KEYWORDS, False)} AS INT) + 2 * CAST({short} AND {named} AS INT) + 3 * CAST({short} AND {leaders} AS INT)
      + 2 * CAST({short} AND {pipe} AND {named} AS INT) + CAST({short} AND {trailing} AND ({named} OR {leaders} OR {pipe}) AS INT))"""


PAGES = "(SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_idx, text AS raw_text FROM documents)"


def _split(table_name: str, keys: str) -> str:
    return f"(SELECT {keys}, CAST(i - 1 AS INT) AS line_no, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT {keys}, {lines('text')} AS ls FROM {table_name})))"


_NUMBERED = ("'o' || o_custkey AS book", "o_custkey AS c", "o_orderkey AS k", "o_orderpriority AS priority", "o_orderstatus AS status", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS n")

#: What rows can be derived from: a customer as a book and its orders as numbered pages or pieces, the lines of documents, the lines of turns.
GIVEN = {
    "orders": f"(SELECT {', '.join(_NUMBERED)} FROM orders)",
    "document_lines": _split("documents", "doc_id"),
    "turn_lines": _split("conversations", "conv_id, turn"),
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of GIVEN[name] on Spark."""
    if name == "orders":
        return table(spark, sf_dir, "orders").selectExpr(*_NUMBERED)
    source, keys = {"document_lines": ("documents", ["doc_id"]), "turn_lines": ("conversations", ["conv_id", "turn"])}[name]
    return table(spark, sf_dir, source).select(*keys, F.posexplode(T.lines(F.col("text"))).alias("line_no", "text"))


def pick(salt: int, m: int) -> str:
    """A number below m by the order's key, in words that both engines read."""
    return f"CAST((k * 7919 + {salt} * 104729) % 1000003 % {m} AS INT)"


def part(salt: int, m: int, by: int) -> str:
    return f"(CAST({pick(salt, m)} AS DOUBLE) / {by})"


def block(size: int) -> str:
    return f"CAST(floor(n / {size}) AS INT)"


def inside(size: int) -> str:
    return f"CAST(n % {size} AS INT)"


def one_of(salt: int, *values: str) -> str:
    return f"CASE {pick(salt, len(values))} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@dataclass(frozen=True)
class Rows:
    """A few odd rows as VALUES, and behind them rows derived from a given table; both engines read the same words."""

    columns: str
    values: str
    more: tuple[str, ...] = ()
    where: str = "true"
    source: str = "orders"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        few = spark.sql(f"SELECT * FROM VALUES {self.values} AS t({self.columns})")
        return few.union(given(spark, sf_dir, self.source).where(self.where).selectExpr(*self.more)) if self.more else few

    @property
    def sql(self) -> str:
        few = f"SELECT * FROM (VALUES {self.values}) AS t({self.columns})"
        return f"({few} UNION ALL SELECT {', '.join(self.more)} FROM {GIVEN[self.source]} AS g WHERE {self.where})" if self.more else f"({few})"

"""Markup, names and metadata as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import SPACE, WORD
from .text import is_page_number, lines, strip


def escape_xml(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def inline_styles(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\*\*(.+?)\*\*", "<b>$1</b>"), r"\*(.+?)\*", "<i>$1</i>")


def paragraph_html(text: Column, first: Column) -> Column:
    inner = inline_styles(escape_xml(text))
    return F.concat(F.when(first, F.lit('<p class="asangre">')).otherwise(F.lit("<p>")), inner, F.lit("</p>"))


def safe_stem(value: Column, default: str = "libro", longest: int | None = None) -> Column:
    """Letters, digits, underscores, spaces and hyphens of a name; the default where none is left."""
    kept = strip(F.regexp_replace(F.coalesce(value, F.lit("")), f"[^{WORD}{SPACE}\\-]", ""))
    kept = F.substring(kept, 1, longest) if longest else kept
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def numbered(prefix: str, number: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 3, "0"), F.lit(suffix))


def caption(page_text: Column, is_full_page: Column) -> Column:
    """An inline picture's caption: its page's lines but blank ones and page numbers; a full page has none."""
    kept = F.filter(F.transform(lines(page_text), strip), lambda x: (x != "") & ~is_page_number(x))
    return F.when(is_full_page, "").otherwise(F.array_join(kept, " "))


def export_name(title: Column) -> Column:
    return F.concat(safe_stem(title, "libro", 80), F.lit(".epub"))


def job_name(started: Column, stem: Column, mark: Column) -> Column:
    """A job's folder: its start, its stem and six letters of a mark that the caller gives."""
    return F.concat_ws("_", F.date_format(started, "yyyyMMdd-HHmmss"), safe_stem(stem), F.substring(mark, 1, 6))

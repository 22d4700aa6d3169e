"""Lines, page predicates, headings and contents scores as Column expressions; none needs a Python worker."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import profile as P
from ..profile import DEFAULT, Profile


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; named expressions would be computed wherever they stand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(("(?iu)" if ignore_case else "") + pattern)


def holds(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts stands in a text, byte by byte, which is much quicker than a pattern of alternatives."""
    return reduce(operator.or_, [text.contains(x) for x in parts])


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included; null stays null."""
    return F.btrim(text, F.lit(P.SPACES))


def collapse(text: Column) -> Column:
    """Stripped, each run of white space one space; most texts have nothing but single spaces, and in others these are passed over."""
    run = f"(?:{P.ODD_SPACE}| [{P.SPACE}])"
    return F.trim(F.when(text.rlike(run), F.regexp_replace(text, f"{run}[{P.SPACE}]*", " ")).otherwise(text))


def lines(text: Column) -> Column:
    """The lines of a text at any Unicode line end, without an empty one after the last; null has none."""
    found = let(F.split(text, P.BREAK, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    return F.coalesce(found, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{P.SPACE}]+"), lambda w: w != "")


def heading_text(text: Column) -> Column:
    return F.btrim(collapse(F.coalesce(text, F.lit(""))), F.lit(P.DECORATION))


def is_structural(text: Column) -> Column:
    """Whether a text starts as a heading does; its first letter rules out most texts at once."""
    return F.when(text.rlike(P.STRUCTURAL_START), matches(heading_text(text), P.STRUCTURAL)).otherwise(False)


def is_subtitle(text: Column, profile: Profile = DEFAULT) -> Column:
    return let(heading_text(text), lambda s: F.when(F.length(s) > profile.subtitle_chars, False).otherwise(let(words(s), lambda w: _is_subtitle(s, w, profile))))


def _is_subtitle(s: Column, w: Column, profile: Profile) -> Column:
    titled = F.size(F.filter(w, lambda x: x.rlike(P.TITLED)))
    ruled_out = (
        (s == "")
        | matches(s, P.STRUCTURAL)
        | (F.length(s) > profile.subtitle_chars)
        | (F.size(w) > profile.subtitle_words)
        | s.rlike(P.LEADERS)
        | (s.contains("|") & s.rlike("[0-9]{1,4}$"))
        | s.rlike("^[0-9]{1,4}$")
        | matches(s, P.NO_SUBTITLE)
    )
    return ~ruled_out & (titled >= F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int")))


def without_page_number(text: Column) -> Column:
    """Stripped; empty if the whole text is a number of up to four digits."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda s: F.when(s.rlike("^[0-9]{1,4}$"), "").otherwise(s))


def is_separator(text: Column, profile: Profile = DEFAULT) -> Column:
    return let(without_page_number(text), lambda cleaned: let(collapse(cleaned), lambda compact: _is_separator(cleaned, compact, profile)))


def _is_separator(cleaned: Column, compact: Column, profile: Profile) -> Column:
    filled = F.size(F.filter(lines(cleaned), lambda x: strip(x) != ""))
    few = (filled <= profile.separator_lines) & (F.regexp_count(compact, F.lit(f"[{P.LETTERS}']+")) <= profile.separator_words)
    return (F.length(compact) <= profile.separator_chars) | (few & (F.regexp_count(compact, F.lit("[.!?¿¡;:]")) <= profile.separator_marks))


def is_image_only(text: Column, profile: Profile = DEFAULT) -> Column:
    return (F.length(collapse(without_page_number(text))) < profile.image_only_chars) | is_separator(text, profile)


def garbage_score(text: Column, profile: Profile = DEFAULT) -> Column:
    """Strange characters, tokens with symbols inside and a lack of letters, up to 1."""
    return let(without_page_number(text), lambda cleaned: let(words(cleaned), lambda chunks: _garbage_score(cleaned, chunks, profile)))


def _garbage_score(cleaned: Column, chunks: Column, profile: Profile) -> Column:
    solid = F.length(F.regexp_replace(cleaned, f"[{P.SPACE}]", "")).cast("double")
    strange = F.length(F.regexp_replace(cleaned, f"[{P.ALLOWED}]", "")) / F.greatest(F.lit(1.0), solid)
    tokens = F.size(F.filter(chunks, lambda c: c.rlike(f"[{P.WORD}]")))
    inside = F.size(F.filter(chunks, lambda c: c.contains("_") | c.rlike(f"[{P.WORD}].*[{P.SUSPICIOUS}].*[{P.WORD}]")))
    letters = F.length(F.regexp_replace(cleaned, r"[^\p{L}]", "")) / F.greatest(F.lit(1.0), solid)
    score = strange + inside / F.greatest(F.lit(1), tokens) + F.when(letters < profile.alpha_ratio, profile.alpha_penalty).otherwise(0.0)
    return F.when(solid == 0, 1.0).otherwise(F.least(F.lit(1.0), score))


def ocr_decision(text: Column, profile: Profile = DEFAULT, mode: str | None = None) -> Column:
    """struct<must_ocr, reason, score>."""
    mode = (mode or profile.ocr_mode).lower()
    made = lambda must, reason, score: F.struct(F.lit(must).alias("must_ocr"), reason.alias("reason"), score.alias("score"))
    if mode == "off":
        return made(False, F.lit("ocr desactivado"), F.lit(0.0))
    if mode == "force":
        return made(True, F.lit("modo force"), F.lit(1.0))
    return let(without_page_number(text), lambda cleaned: let(garbage_score(cleaned, profile), lambda score: _ocr_decision(cleaned, score, made, profile)))


def _ocr_decision(cleaned: Column, score: Column, made: Callable[..., Column], profile: Profile) -> Column:
    return (
        F.when(F.length(cleaned) < profile.ocr_min_text_chars, made(True, F.lit(f"texto escaso (< {profile.ocr_min_text_chars} chars)"), F.lit(1.0)))
        .when(score >= profile.ocr_garbage_threshold, made(True, F.format_string("texto corrupto (score=%.2f)", score), score))
        .otherwise(made(False, F.lit("texto suficiente"), score))
    )


def header_footer_form(line: Column) -> Column:
    """A line with its page number replaced by a mark; empty for headings."""
    def finish(s: Column, marked: Column, last: Column) -> Column:
        return (
            F.when((s == "") | is_structural(s), "")
            .when(s.rlike("^[\\-–— ]*[0-9]{1,4}[\\-–— ]*$") | marked.rlike("^[\\-–— ]*<PAGE_NUM>[\\-–— ]*$"), "<PAGE_NUM>")
            .when(is_structural(last), "")
            .otherwise(last)
        )

    phrase = lambda s: F.regexp_replace(s, f"(?iu)(?<![{P.WORD}])(p[áa]g(?:ina)?\\.? *)[0-9]{{1,4}}(?![{P.WORD}])", "$1<PAGE_NUM>")
    page = lambda m: F.when(m.rlike(P.PAGE_LINE), F.regexp_replace(m, "[0-9]{1,4} *$", "<PAGE_NUM>")).otherwise(m)
    numbers = lambda m: collapse(F.regexp_replace(m, f"(?<![{P.WORD}])[0-9]{{1,4}}(?![{P.WORD}])", "<PAGE_NUM>"))
    full = lambda s: let(let(phrase(s), page), lambda m: let(numbers(m), lambda last: finish(s, m, last)))
    # Without a digit or a mark there is nothing to replace.
    return let(collapse(F.coalesce(line, F.lit(""))), lambda s: F.when(s.rlike("[0-9]") | s.contains("<PAGE_NUM>"), full(s)).when(is_structural(s), "").otherwise(s))


def is_page_number(line: Column) -> Column:
    return line.rlike("^[0-9]{1,4}$")


def is_page_phrase(line: Column) -> Column:
    """Phrases that a cleaned line may not hold, wherever it stands."""
    return line.rlike("[0-9]") & (matches(line, P.PAGE_PHRASE) | matches(line, P.SHORT_PAGE_PHRASE) | line.rlike(P.DASHED_NUMBER) | line.rlike(P.PAGE_LINE))


def is_variable_border(line: Column) -> Column:
    return line.rlike("[0-9]") & (matches(line, P.PAGE_PHRASE) | matches(line, P.SHORT_PAGE_PHRASE) | is_page_number(line) | line.rlike(P.DASHED_NUMBER))


def toc_score(text: Column, profile: Profile = DEFAULT) -> Column:
    return let(heading_text(text), lambda s: let(F.lower(s), lambda lower: _toc_score(s, lower, profile)))


def _toc_score(s: Column, lower: Column, profile: Profile) -> Column:
    short = (F.length(s) <= profile.toc_entry_chars) & (F.size(words(s)) <= profile.toc_entry_words)
    named, leaders, pipe = lower.rlike(P.TOC_SECTIONS), s.rlike(P.LEADERS), s.contains("|")
    trailing = s.rlike(f"(^|[^{P.WORD}])[0-9]{{1,4}}$")
    part = lambda condition, n: F.when(condition, n).otherwise(0)
    return part(holds(lower, P.TOC_PARTS), 4) + part(short & named, 2) + part(short & leaders, 3) + part(short & pipe & named, 2) + part(short & trailing & (named | leaders | pipe), 1)


def is_toc_page(paragraphs: Column) -> Column:
    """Whether an array of paragraphs is a table of contents; what no rule could find is ruled out before paragraphs are scored."""
    scored = lambda joined, lower: let(F.transform(paragraphs, lambda x: toc_score(x)), lambda scores: _is_toc_page(joined, lower, scores))
    found = lambda joined, lower: F.when(holds(lower, P.TOC_PARTS), True).when(holds(lower, P.SECTION_PARTS) | joined.contains(".."), scored(joined, lower)).otherwise(False)
    return (F.size(paragraphs) > 0) & let(F.array_join(paragraphs, " "), lambda whole: let(heading_text(whole), lambda joined: let(F.lower(joined), lambda lower: found(joined, lower))))


def _is_toc_page(joined: Column, lower: Column, scores: Column) -> Column:
    strong, medium = F.size(F.filter(scores, lambda s: s >= 3)), F.size(F.filter(scores, lambda s: s >= 2))
    mentions = F.regexp_count(lower, F.lit(P.TOC_MENTIONS))
    numbers = F.regexp_count(lower, F.lit(f"(?<![{P.WORD}])[0-9]{{1,4}}(?![{P.WORD}])"))
    dots = F.regexp_count(joined, F.lit("\\.{2,}"))
    return (strong >= 2) | ((medium >= 3) & (numbers >= 3)) | ((mentions >= 3) & ((numbers >= 3) | (dots >= 2)))


def is_short_heading(text: Column, profile: Profile = DEFAULT) -> Column:
    s = heading_text(text)
    return (s != "") & (F.length(s) <= profile.heading_chars) & (F.regexp_count(s, F.lit("\\.")) < profile.heading_dots)


def special_kind(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """The first special section kind whose pattern a heading text fits, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(P.SPECIAL):
        if kinds is None or kind in kinds:
            out = F.when(matches(text, pattern), kind).otherwise(out)
    return out


def special_title(kind: Column, text: Column) -> Column:
    s = heading_text(text)
    number = F.regexp_extract(s, "(?iu)([0-9]+|[ivxlcdm]+)", 1)
    return (
        F.when(kind == "prologue", "Prólogo")
        .when(kind == "epilogue", "Epílogo")
        .when(kind == "afterword", F.when(F.lower(s).startswith("afterword"), "Afterword").otherwise("Palabras del autor"))
        .when(kind == "acknowledgements", F.when(F.lower(s).startswith("agradecimiento"), "Agradecimiento").otherwise("Agradecimientos"))
        .when(kind == "short_story", "Short Story")
        .when(kind == "part", F.when(number != "", F.concat(F.lit("Parte "), number)).otherwise("Parte"))
        .otherwise(F.when(s != "", s).otherwise("Extra"))
    )


def page_heading(paragraphs: Column, allow_terminal: Column | bool = True, profile: Profile = DEFAULT) -> Column:
    """struct<kind, title, subtitle, consume> of a page's paragraphs, or null."""
    allowed = allow_terminal if isinstance(allow_terminal, Column) else F.lit(allow_terminal)
    candidates = F.filter(F.transform(F.slice(paragraphs, F.lit(1), F.lit(profile.heading_candidates)), heading_text), lambda x: x != "")
    return let(candidates, lambda c: _page_heading(c, allowed, profile))


def _page_heading(candidates: Column, allowed: Column, profile: Profile) -> Column:
    heads = lambda x: special_kind(x).isNotNull() | matches(x, P.CHAPTER) | matches(x, P.PART) | matches(x, P.SHORT_STORY)
    place = F.array_position(F.transform(F.slice(candidates, F.lit(1), F.lit(profile.heading_lookahead)), heads), True).cast("int")
    at = F.greatest(place, F.lit(1))
    found = let(at, lambda at: let(F.get(candidates, at - 1), lambda first: let(F.get(candidates, at), lambda follower: _heading_at(at, first, follower, allowed))))
    toc = let(F.get(candidates, 0), lambda x: toc_score(x) >= 3) & is_toc_page(candidates)
    return F.when((F.size(candidates) > 0) & ~toc, found)


def _heading_at(at: Column, first: Column, follower: Column, allowed: Column) -> Column:
    usable = follower.isNotNull() & is_subtitle(follower) & (toc_score(follower) < 2)
    kind = F.when(allowed, special_kind(first)).otherwise(special_kind(first, tuple(k for k, _ in P.SPECIAL if k not in P.TERMINAL)))
    plain = special_kind(follower).isNull() & ~matches(follower, P.CHAPTER)
    author = (kind == "afterword") & matches(follower, "^palabras del autor$")

    def made(kind: Column, title: Column, own: Column, takes: Column) -> Column:
        takes = takes & (own == "")
        subtitle = F.when(takes, follower).otherwise(own)
        return F.struct(kind.alias("kind"), title.alias("title"), subtitle.alias("subtitle"), (at + takes.cast("int")).alias("consume"))

    group = lambda pattern, k: strip(F.regexp_extract(first, "(?iu)" + pattern, k))
    no, short = F.coalesce(usable, F.lit(False)), is_short_heading(first)
    label = group(P.CHAPTER, 2)
    label = F.when(label.rlike(r"^\p{L}+$"), F.initcap(label)).otherwise(label)
    return (
        F.when(kind.isNotNull() & short, made(kind, special_title(kind, first), F.lit(""), no & F.coalesce(author | plain, F.lit(False))))
        .when(matches(first, P.CHAPTER) & short, made(F.lit("chapter"), F.concat(F.lit("Capítulo "), label), group(P.CHAPTER, 4), no & F.coalesce(plain, F.lit(False))))
        .when(matches(first, P.PART) & short, made(F.lit("part"), F.concat(F.lit("Parte "), group(P.PART, 2)), group(P.PART, 4), no))
        .when(matches(first, P.SHORT_STORY), made(F.lit("short_story"), F.lit("Short Story"), F.lit(""), no))
        .when(first.rlike(P.NUMBERED) & short, made(F.lit("chapter"), F.concat(F.lit("Capítulo "), F.regexp_extract(first, P.NUMBERED, 1)), strip(F.regexp_extract(first, P.NUMBERED, 2)), F.lit(False)))
    )


def dialogue_class(text: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(P.DIALOGUE):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out

"""Every threshold and vocabulary of the engine, in one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    # They must equal the documented behaviour.
    image_only_chars: int = 20
    separator_chars: int = 70
    separator_lines: int = 4
    separator_words: int = 14
    separator_marks: int = 1
    ocr_mode: str = "off"
    ocr_lang: str = "spa+eng"
    ocr_dpi: int = 300
    ocr_min_text_chars: int = 90
    ocr_garbage_threshold: float = 0.22
    ocr_psm: int = 3
    ocr_oem: int = 3
    alpha_ratio: float = 0.55
    alpha_penalty: float = 0.25
    border_high: float = 0.90
    border_low: float = 0.10
    min_repeat: int = 4
    edge_lines: int = 3
    line_min_chars: int = 3
    subtitle_chars: int = 120
    subtitle_words: int = 14
    toc_entry_chars: int = 140
    toc_entry_words: int = 18
    toc_continuation_paragraphs: int = 6
    toc_continuation_score: int = 5
    toc_scan_pages: int = 40
    heading_candidates: int = 5
    heading_lookahead: int = 4
    heading_chars: int = 120
    heading_dots: int = 3
    decorative_least: int = 5
    decorative_share: float = 0.10
    decorative_area: int = 120_000
    decorative_side: int = 600
    cover_area: int = 160_000
    cover_bytes: int = 12_000
    neighbour_pages: int = 2
    pair_ratio: float = 1.9
    pair_area: int = 3_000_000
    dialogue_paragraphs: int = 20
    publisher: str = ""
    lang: str = "es"
    date: str = "2026"
    unknown_author: str = "Desconocido"


DEFAULT = Profile()

# Character classes and vocabularies, in a spelling that Java's and RE2's regular expressions share.
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space but the space itself; the ordinary ASCII characters are ruled out first, which is quicker.
ODD_SPACE = rf"[\x00-\x1F\x7F-\x{{FFFF}}&&[{SPACE}]]"
WORD = r"\p{L}\p{N}_"
BREAK = r"\r\n|[\n\x{0B}\x{0C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
DECOR = r"\-—–―| "
DECORATION = "-—–―| "
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
ALLOWED = LETTERS + r"0-9" + SPACE + r".,;:!?¡¿()\[\]{}\-—–_\"'/%&@#=+*…ºª€$"
SUSPICIOUS = r"*\[\]{}|\\`~^<>"
STRUCTURAL = r"^(cap[ií]tulo|chapter|parte|pr[oó]logo|prologue|ep[ií]logo|afterword|short +story|palabras del autor|agradecimientos?|acknowledgements?)([^\p{L}\p{N}_]|$)"
#: What stands before the first letter of a structural heading, and that letter (ſ is an s in any case).
STRUCTURAL_START = f"^[{SPACE}{DECOR}]*[CcPpEeAaSsſ]"
NO_SUBTITLE = r"^(cap[ií]tulo|chapter|parte|pr[oó]logo|ep[ií]logo|afterword|short +story)([^\p{L}\p{N}_]|$)"
TITLED = r"^[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+"
PAGE_LINE = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9 .:'’_\-]{3,80} *\| *[0-9]{1,4}$"
DASHED_NUMBER = r"^[\-–—] *[0-9]+ *[\-–—]$"
PAGE_PHRASE = r"p[áa]gina +n[°º]? *[0-9]+"
SHORT_PAGE_PHRASE = r"(^|[^\p{L}\p{N}_])pág(ina)? *\.? *[0-9]+"
TOC_KEYWORDS = r"tabla de contenido|contenido|table of contents|contents|índice|indice|toc"
TOC_SECTIONS = r"cap[ií]tulo|chapter|prólogo|prologo|ep[ií]logo|afterword|palabras del autor|agradecimiento"
TOC_MENTIONS = r"cap[ií]tulo|chapter|pr[óo]logo|ep[ií]logo|afterword"
#: One of these stands in every text that TOC_KEYWORDS fits, and only there; one of the others in every text that TOC_SECTIONS or TOC_MENTIONS fits.
TOC_PARTS = ("contenido", "contents", "índice", "indice", "toc")
SECTION_PARTS = ("tulo", "chapter", "logo", "afterword", "palabras del autor", "agradecimiento")
LEADERS = r"\.{2,}[ ]*[0-9]{1,4}$"
CHAPTER = r"^(capítulo|capitulo|chapter|cap\.) *([0-9]+|[ivxlcdm]+|extra|especial)( *[:.\-–—|] *(.+))?$"
PART = r"^(parte|part) *([0-9]+|[ivxlcdm]+)( *[:.\-–—|] *(.+))?$"
SHORT_STORY = r"^short +story$"
NUMBERED = r"^([0-9]{1,3})[.\-–] +([A-ZÁÉÍÓÚ].{3,})$"
SPECIAL = (
    ("prologue", r"^(prólogo|prologo|prefacio|foreword|introducción|introduccion)([^\p{L}\p{N}_]|$)"),
    ("epilogue", r"^(epílogo|epilogo)([^\p{L}\p{N}_]|$)"),
    ("afterword", r"^(afterword|palabras del autor)([^\p{L}\p{N}_]|$)"),
    ("acknowledgements", r"^(agradecimientos?|acknowledgements?)([^\p{L}\p{N}_]|$)"),
    ("short_story", r"^(short +story)([^\p{L}\p{N}_]|$)"),
    ("part", r"^parte +([0-9]+|[ivxlcdm]+)([^\p{L}\p{N}_]|$)"),
    ("extra", r"^(omake|extra)([^\p{L}\p{N}_]|$)"),
)
TERMINAL = ("epilogue", "afterword", "acknowledgements")
BODY = ("prologue", "chapter")
PARAGRAPH_END = "[.!?»\"'—”’]$"
DIALOGUE_START = "^[—–\\-\"«“‘]"
SENTENCE_START = "^[A-ZÁÉÍÓÚÜÑ\"«“‘—–]"
DIALOGUE = (("guion", "^[—–]"), ("guion2", "^─"), ("comillas", "^[\"«“]"))

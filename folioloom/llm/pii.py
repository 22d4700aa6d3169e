"""PII: candidate spans scored by gradient-boosted trees, all in DataFrame expressions.

Generators with high recall propose spans, which may overlap: the four base
kinds, and looser forms (numbers with separators, spelled-out addresses, social
security and account numbers, keys and tokens).  Each candidate has features of
its format and of the characters before and after it.  Boosted trees, fitted in
numpy on labelled lines that `training_lines` makes by rule (TRAINING_LINES of
them: no corpus rows), become one Column expression; a candidate is redacted if
its score passes its kind's threshold, which reaches PRECISION on lines kept out
of the fit.  Base spans that pass their checks are always redacted.

Offsets come from the texts between matches, in blocks, and what is read for
each match is small, so time grows with the text and its matches.  Null text is empty and has no spans.  Null doc_id and repeated rows are
kept, each with its own result.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_before, sums_before

TRAINING_LINES, PRECISION = 2000, 0.995
TREES, RATE, BINS = 16, 0.6, 12

#: Base kinds in the order in which spans are listed, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "number", "iban", "secret")

#: Fixed patterns of the base kinds; possessive, with starts inside a run ruled out, so that a long run is read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]{1,64}){1,4}",
    "number": r"(?<![A-Za-z0-9.])[0-9(](?:[\x20().-]{0,2}[0-9]){6,20}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?![0-9]++(?![A-Za-z_/+-]))[A-Za-z0-9_/+-]{16,}+={0,2}+",
}
#: What a text must hold for a kind's pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "address": "[\\x20(\\[{]at[\\x20)\\]}]", "number": "[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[0-9A-Za-z_/+-]{16}"}
CONTEXT = 24
WORDS = {
    "says_phone": "phone|call|mobile|fax|whatsapp|sms|telef|handy|rufnummer|\\btel\\b|\\btel\\.",
    "says_card": "card|visa|mastercard|amex|karte|tarjeta|carte|iban|account|konto|cuenta|compte",
    "says_person": "ssn|social security|passport|licen[cs]e no|tax id|ausweis|dni|nie\\b",
    "says_secret": "token|secret|password|passwd|api[_ -]?key|access[_ -]?key|bearer|private key|\\bkey\\b",
    "says_mail": "mail|contact|write to|kontakt|correo",
    "says_other": "version|isbn|issn|order|invoice|page|chapter|build|commit|serial|model|total|population|sha|md5|hash|figure|table|line|base64",
}


def _tried(text: Column, kind: str) -> Column:
    return text.contains("@") if NEEDS[kind] == "@" else text.rlike(NEEDS[kind])


def _found(docs: DataFrame, text: Column, kinds: tuple[str, ...]) -> DataFrame:
    """docs with __found_<kind>, array<struct<kind, start, end, value, before, after>> of each pattern's matches, null without one; positions in code points.

    What a lambda reads of a text is a column of an earlier projection, so that nothing of the text's size is done again for each match.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    values, gaps, lengths, starts = ({k: f"__{name}_{k}" for k in kinds} for name in ("values", "gaps", "lengths", "starts"))
    x = docs.select(*own, *(F.when(_tried(text, k), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).alias(values[k]) for k in kinds), text.alias("__text"))
    hit = lambda k: F.size(values[k]) > 0
    x = x.select(*own, *values.values(), *(F.when(hit(k), F.split("__text", PATTERNS[k], -1)).alias(gaps[k]) for k in kinds))
    first = lambda k: F.slice(gaps[k], F.lit(1), F.size(values[k]))
    x = x.select(*own, *values.values(), *gaps.values(), *(F.when(hit(k), F.zip_with(values[k], first(k), lambda v, g: F.length(v) + F.length(g))).alias(lengths[k]) for k in kinds))
    x = x.select(*own, *values.values(), *gaps.values(), *(F.when(hit(k), sums_before(F.col(lengths[k]))).alias(starts[k]) for k in kinds))

    def made(kind: str) -> Column:
        n = F.size(values[kind])
        rows = F.arrays_zip(F.col(values[kind]).alias("v"), F.col(starts[kind]).alias("s"), F.slice(gaps[kind], F.lit(1), n).alias("g"), F.slice(gaps[kind], F.lit(2), n).alias("h"))
        start = lambda m: m["s"] + F.length(m["g"])
        spans = F.transform(rows, lambda m: F.struct(
            F.lit(kind).alias("kind"), start(m).alias("start"), (start(m) + F.length(m["v"])).alias("end"), m["v"].alias("value"),
            F.lower(F.substring(m["g"], -CONTEXT, CONTEXT)).alias("before"), F.substring(m["h"], 1, 8).alias("after"),
        ))
        return F.when(hit(kind), spans).alias(f"__found_{kind}")

    # A generator of one row: filters on what comes of it are not written out again through all these projections.
    return x.select(F.inline(F.array(F.struct(*own, *map(made, kinds)))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' checksum holds; each is read once, from the last on."""
    none = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))
    worth = lambda a, d: F.when(a["twice"], 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.ascii(d) - 48)
    return F.aggregate(each, none, lambda a, d: F.struct((a["sum"] + worth(a, d)).alias("sum"), (~a["twice"]).alias("twice")), lambda a: a["sum"] % 10 == 0)


def passes(kind: str, value: Column) -> Column:
    """The base kinds' own checks."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "\\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def features(c: Column) -> dict[str, Column]:
    """Numbers of a candidate's format and context."""
    value, digits = c["value"], _digits(c["value"])
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / F.length(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    out = {f"is_{k}": (c["kind"] == k).cast("double") for k in KINDS}
    out |= {
        "length": F.length(value).cast("double"),
        "digits": F.length(digits).cast("double"),
        "digit_share": share("[^0-9]"),
        "upper_share": share("[^A-Z]"),
        "hex_share": share("[^0-9a-fA-F]"),
        "changes": count("[0-9][A-Za-z]|[A-Za-z][0-9]"),
        "groups": count("[0-9]+"),
        "separators": count("[ ().-]"),
        "brackets": count("[()\\[\\]{}]"),
        "dots": count("\\."),
        "slashes": count("[/+]"),
        "spelled": value.rlike("[(\\[{]at[)\\]}]|\\bdot\\b").cast("double"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False).cast("double"),
        "after_sign": c["before"].rlike("[=:+\"'#]\\s*$").cast("double"),
        "quoted": c["after"].rlike("^[\"']").cast("double"),
        "key_prefix": value.rlike("^(AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|xox|AIza|eyJ)").cast("double"),
        "area_form": value.rlike("^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-]?[0-9]{4}$").cast("double"),
        "ssn_form": value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("double"),
        "date_form": value.rlike("^[12][0-9]{3}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|^[0-9]{1,2}[-. ][0-9]{1,2}[-. ][12][0-9]{3}$|^[12][0-9]{3}[ -]+[12][0-9]{3}$").cast("double"),
    }
    return out | {k: c["before"].rlike(p).cast("double") for k, p in WORDS.items()}


def training_forms(rng: random.Random | None = None) -> tuple[list, list]:
    """Forms of private data and of look-alikes: functions that make (text before, span)."""
    rng = rng or random.Random()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    among = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    low, up, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    base64 = low + up + "0123456789+/"
    word = lambda: among(low, rng.randint(2, 10))

    def luhn_number(k: int) -> str:
        body = digits(k - 1)
        total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    sep = lambda s, k, c: c.join(s[i : i + k] for i in range(0, len(s), k))
    say = lambda *words: rng.choice(words) + rng.choice([" ", ": ", " is "])
    plain = lambda: rng.choice(["", f"{word()} {word()} "])
    private = [
        lambda: (plain(), f"{word()}.{digits(2)}@{word()}.{rng.choice(['com', 'org'])}"),
        lambda: (plain(), f"{word()}{rng.choice([' (at) ', ' [at] ', '(at)', '[at]'])}{word()}{rng.choice([' (dot) ', '.', ' [dot] '])}com"),
        lambda: (say("mail me", "contact"), f"{word()} at {word()} dot com"),
        lambda: (plain(), f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}"),
        lambda: (plain(), sep(luhn_number(16), 4, rng.choice(["", " ", "-"]))),
        lambda: (say("card", "visa", "tarjeta", "carte"), sep(digits(16), 4, rng.choice([" ", "-", ""]))),
        lambda: (plain(), digits(16)),
        lambda: (plain(), f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (say("phone", "call", "mobile", "tel", "fax"), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(7)}"])),
        lambda: (plain(), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])),
        lambda: (rng.choice([plain, lambda: say("ssn", "social security number")])(), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (plain(), f"{among(up, 2)}{digits(2)}{sep(digits(16), 4, rng.choice(['', ' ']))}"),
        lambda: (rng.choice(["token = \"", "api_key: ", "secret=", "password: ", "bearer "]), among(hexa, rng.choice([32, 40, 64]))),
        lambda: (plain(), "AKIA" + among(up + "234567", 16)),
        lambda: (plain(), rng.choice(["ghp_", "sk-", "xoxb-"]) + among(low + up + "0123456789", 32)),
        lambda: (say("key", "access key", "token"), among(low + up + "0123456789", rng.randint(20, 40))),
        lambda: (say("secret", "private key", "access key", "token"), among(base64, rng.choice([40, 64, 128, 300])) + rng.choice(["", "=", "=="])),
        lambda: (rng.choice([plain(), "bearer "]), "eyJ" + among(low + up + "0123456789_-", rng.randint(30, 300))),
    ]
    other = [
        lambda: (say("version", "build"), f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(4)}"),
        lambda: (say("isbn", "issn"), f"978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}"),
        lambda: (say("order", "invoice", "serial", "model"), digits(rng.randint(7, 12))),
        lambda: (plain(), f"{rng.randint(1500, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"),
        lambda: (plain(), f"{rng.randint(1500, 2099)} {rng.randint(1500, 2099)}"),
        lambda: (plain(), f"{rng.randint(1500, 2099)}-{rng.randint(1500, 2099)}"),
        lambda: (say("total", "population"), f"{digits(1)} {digits(3)} {digits(3)}"),
        lambda: (plain(), digits(rng.randint(7, 11))),
        lambda: (plain(), digits(rng.randint(20, 21))),
        lambda: (plain(), f"3.{digits(rng.randint(8, 14))}"),
        lambda: (plain(), among(low, rng.randint(16, 40))),
        lambda: (plain(), among(up, rng.randint(16, 40))),
        lambda: (plain(), among(up, 1) + among(low, rng.randint(16, 30))),
        lambda: (plain(), f"{among(low, 7)}-{among(low, 6)}-{among(low, 5)}"),
        lambda: (plain(), f"{among(low, 9)}_{among(low, 9)}_{rng.randint(1, 99)}"),
        lambda: (plain(), rng.choice(["", "/"]) + "/".join(word() for _ in range(rng.randint(4, 9)))),
        lambda: (plain(), f"{rng.randint(1990, 2030)}/{rng.randint(1, 12):02}/" + "-".join(word() for _ in range(rng.randint(3, 8)))),
        lambda: ("base64,", among(base64, rng.randint(40, 400))),
        lambda: (say("commit", "sha", "md5", "hash"), among(hexa, rng.choice([32, 40]))),
        lambda: (plain(), rng.choice(["-", "_", "/", "+", "+-", "-/"]) * rng.randint(16, 60)),
        lambda: (rng.choice(["look ", "arrive ", "we met "]), f"{word()} at {word()}.{word()}"),
        lambda: (plain(), " ".join(str(rng.randint(1, 99)) for _ in range(rng.randint(5, 9)))),
    ]
    return private, other


def training_lines(n: int = TRAINING_LINES, seed: int = 11, forms: Sequence[int] | None = None) -> list[tuple[str, str, int]]:
    """(line, span, 1 if the span is private) made by rule, of all private forms or those whose numbers are given."""
    rng = random.Random(seed)
    private, other = training_forms(rng)
    private = private if forms is None else [private[k] for k in forms]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10)))
    out = []
    for k in range(n):
        label = k % 2
        before, span = rng.choice(private if label else other)()
        after = '"' if before.endswith('"') else ""
        out.append((f"{word()} {word()} {before}{span}{after}{rng.choice(['', ',', '.', '!!'])} {word()}", span, label))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> list:
    """Boosted trees of depth 3 for the log loss; a tree is a number or (feature, bound, tree if below or equal, tree above)."""
    bounds = [np.unique(np.quantile(np.unique(column), np.linspace(0, 1, BINS)))[:-1] for column in x.T]
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    out: list = [float(score[0])] if len(y) else [0.0]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        best, choice = 1e-6, None
        if depth:
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f, cut in enumerate(bounds):
                for c in cut:
                    low = rows[x[rows, f] <= c]
                    if 4 < len(low) < len(rows) - 4:
                        gl, hl = g[low].sum(), h[low].sum()
                        gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                        gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - base
                        if gain > best:
                            best, choice = gain, (f, float(c))
        if choice is None:
            return leaf
        f, c = choice
        below = x[rows, f] <= c
        return f, c, grow(rows[below], g, h, depth - 1), grow(rows[~below], g, h, depth - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 3)
        score += [value(tree, row) for row in x]
        out.append(tree)
    return out


def value(tree, row) -> float:
    while not isinstance(tree, float):
        f, c, below, above = tree
        tree = below if row[f] <= c else above
    return tree


def _tree(tree, columns: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, c, below, above = tree
    return F.when(columns[f] <= c, _tree(below, columns)).otherwise(_tree(above, columns))


class Model:
    """Trees and, by kind, the threshold of their summed scores."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def redacts(self, kind: Column, numbers: Column) -> Column:
        """numbers: an array of the features of a candidate of the kind."""
        columns = [numbers[i] for i in range(len(NAMES))]
        bound = reduce(lambda rest, k: F.when(kind == k, self.thresholds[k]).otherwise(rest), KINDS, F.lit(float("inf")))
        return reduce(lambda a, b: a + b, [_tree(t, columns) for t in self.trees]) >= bound


NAMES = [*[f"is_{k}" for k in KINDS], "length", "digits", "digit_share", "upper_share", "hex_share", "changes", "groups", "separators", "brackets", "dots", "slashes", "spelled", "luhn", "after_sign", "quoted", "key_prefix", "area_form", "ssn_form", "date_form", *WORDS]


def _numbers(c: Column) -> Column:
    made = features(c)
    return F.array(*(made[k] for k in NAMES))


def train(spark: SparkSession, lines: int = TRAINING_LINES, precision: float = PRECISION, made: list[tuple[str, str, int]] | None = None) -> Model:
    """Fits on two thirds of the lines' candidates; a kind's threshold is the least that reaches the precision on the rest.

    made: labelled lines instead of `lines` ones made by rule.
    """
    made = made or training_lines(lines)
    rows = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps([{"text": t, "span": s, "label": y} for t, s, y in made])), "array<struct<text:string,span:string,label:int>>")).alias("r")).select("r.*")
    found = candidates(rows, F.col("text")).select(*rows.columns, F.explode("__candidates").alias("c"))
    at = F.instr(F.col("text"), F.col("span")) - 1
    overlap = F.least("c.end", at + F.length("span")) - F.greatest("c.start", at)
    found = found.where(overlap * 10 >= 8 * F.length("span")).select(_numbers(F.col("c")).alias("x"), (F.col("label") * (overlap * 10 >= 8 * (F.col("c.end") - F.col("c.start"))).cast("int")).alias("y"), F.pmod(F.xxhash64("text"), F.lit(3)).alias("fold"))
    got = found.collect()
    x, y, fold = np.array([r.x for r in got]), np.array([float(r.y) for r in got]), np.array([r.fold for r in got])
    trees = fit(x[fold > 0], y[fold > 0])
    score = np.array([sum(value(t, row) for t in trees) for row in x])

    def threshold(kind: str) -> float:
        mine = (fold == 0) & (x[:, NAMES.index(f"is_{kind}")] > 0)
        scores, kept = score[mine], y[mine]
        return max(0.0, float(next((s for s in np.sort(scores) if kept[scores >= s].mean() >= precision), scores.max(initial=0.0))))

    return Model(trees, {kind: threshold(kind) for kind in KINDS})


def candidates(docs: DataFrame, text: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with __candidates: what the patterns of all kinds find, in one array."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")
    return _found(docs, text, kinds).select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(*(F.coalesce(f"__found_{k}", none) for k in kinds)).alias("__candidates"))


_BARE = "array<struct<kind:string,start:int,end:int>>"


def _bare(found: Column) -> Column:
    return F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _with_spans(docs: DataFrame, text: Column, model: Model) -> DataFrame:
    """docs with __base and __spans of a text, each a filter of one list of candidates by kind, then start; base spans that pass need no score."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    fields = ("kind", "start", "end", "value", "before", "after")

    def checked(kind: str) -> Column:
        ok = lambda c: passes(kind, c["value"]) if kind in BASE else F.lit(False)
        rows = F.transform(f"__found_{kind}", lambda c: F.struct(*(c[f].alias(f) for f in fields), ok(c).alias("ok")))
        return F.coalesce(rows, F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string,ok:boolean>>"))

    found = _found(docs, text, KINDS).select(*own, F.concat(*map(checked, KINDS)).alias("__every"))
    scored = F.transform("__every", lambda c: F.struct(*(c[f].alias(f) for f in ("kind", "start", "end", "ok")), F.when(~c["ok"], _numbers(c)).alias("x")))
    found = found.select(*own, scored.alias("__scored"))
    found = found.select(*own, F.filter("__scored", lambda c: F.when(c["ok"], True).otherwise(model.redacts(c["kind"], c["x"]))).alias("__taken"))
    found = found.select(*own, _bare(F.filter("__taken", lambda c: c["ok"])).alias("__base"), _bare(F.col("__taken")).alias("__spans"))
    return found.select(F.inline(F.array(F.struct("*"))))


def private_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, base (checked spans of the base kinds) and spans (all that are redacted), by kind, then start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _with_spans(docs, F.col("text"), model).select("doc_id", "text", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


_RUN = "array<struct<start:int,end:int,kind:string>>"


def merged(docs: DataFrame, spans: str) -> DataFrame:
    """docs with __runs: runs of overlapping spans of that column, each with the kind of its first one."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    x = docs.select(*own, by_start.alias("__sorted")).withColumn("__ends", F.col("__sorted.end")).withColumn("__past", most_before(F.col("__ends")))
    # A run opens where a span starts at or behind all ends so far, and ends at the largest end before the next one opens.
    rows = F.arrays_zip(F.col("__sorted").alias("s"), F.col("__past").alias("p"))
    x = x.withColumn("__open", F.filter(rows, lambda r: r["s"]["start"] >= r["p"]))
    ends = F.concat(F.slice(F.col("__open.p"), F.lit(2), F.size("__open")), F.array(F.array_max("__ends")))
    runs = F.zip_with("__open", ends, lambda r, end: F.struct(r["s"]["start"].alias("start"), end.alias("end"), r["s"]["kind"].alias("kind")))
    return x.select(*own, F.when(F.size("__open") > 0, runs).otherwise(F.array().cast(_RUN)).alias("__runs"))


#: Runs that are replaced together, so that a text is cut from its beginning once for so many of them.
TOGETHER = 128


def replaced(text: Column, runs: Column) -> Column:
    """The text with each run (both columns of their own) replaced by its kind in brackets."""
    count = F.floor((F.size(runs) - 1) / TOGETHER).cast("int")
    groups = F.transform(F.sequence(F.lit(0), count), lambda g: F.struct(F.slice(runs, g * TOGETHER + 1, F.lit(TOGETHER)).alias("runs"), F.when(g > 0, F.get(runs, g * TOGETHER - 1)["end"]).otherwise(0).alias("from")))
    groups = F.transform(groups, lambda g: F.struct(g["runs"].alias("runs"), g["from"].alias("from"), F.substr(text, g["from"] + 1, F.element_at(g["runs"], -1)["start"] - g["from"]).alias("part")))

    def filled(g: Column) -> Column:
        past = lambda i: F.when(i > 0, F.get(g["runs"], i - 1)["end"]).otherwise(g["from"])
        return F.array_join(F.transform(g["runs"], lambda r, i: F.concat(F.substr(g["part"], past(i) - g["from"] + 1, r["start"] - past(i)), F.lit("["), F.upper(r["kind"]), F.lit("]"))), "")

    rest = F.substr(text, F.element_at(runs, -1)["end"] + 1, F.length(text))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(F.transform(groups, filled), ""), rest)).otherwise(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the private spans of text replaced; n_chars, where there is one, follows. Null text stays null."""
    out = _with_spans(docs, F.coalesce(F.col("text").cast("string"), F.lit("")), model)
    out = merged(out, "__spans")
    out = out.withColumn("text", replaced(F.col("text"), F.col("__runs")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

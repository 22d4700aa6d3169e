"""URL filters with redirect equivalence.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest wins, of equally long ones an allow, then the greatest host.  A few
rules come as a list and make one expression; a table of any number of rules
(verdict, host, path) comes as a DataFrame and is joined.  Pages that no rule fits
take the decision of their equivalence class: the connected component over
redirects and canonical links, found distributedly.  A class with an allowed
member is allowed; else one with a blocked member is blocked; else the default
holds.

Null url or one without "://": host and path empty, no rule, no links.  Null
html: no links.  Repeated rows and null page ids keep their own results.
Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Shelf
from .graph import components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == ALLOW, r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


#: Copies of each row of a rule table in its joins, so that a host or url with a large share of the rows is met in as many tasks.
SALTS = 16


def _salted(left: DataFrame, by: Column, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with the smaller right on keys; rows of one key are dealt by `by`."""
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(right, [*keys, "__salt"], how).drop("__salt")


def fitting_rows(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own) for the distinct (host, path) of urls that a rule of the table (verdict, host, path) fits.

    Each host's suffixes meet the rules' hosts, which say how long their paths
    are; then heads of just these lengths meet the rules themselves.  Rules
    without a host or with another verdict are left out; a null path is empty.
    """
    table = rules.where(F.col("host").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)).groupBy(F.col("host").alias("__host"), F.coalesce("path", F.lit("")).alias("__head")).agg(F.max(F.col("verdict") == ALLOW).alias("__allow"))
    lengths = table.groupBy("__host").agg(F.collect_set(F.length("__head")).alias("__lengths"))
    keys = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = _salted(keys.select("host").distinct().withColumn("__host", F.explode(suffixes)), F.col("host"), lengths, ["__host"])
    hosts = hosts.groupBy("host").agg(F.collect_list(F.struct("__host", "__lengths")).alias("__reach"))
    heads = _salted(keys, F.col("path"), hosts, ["host"]).select("host", "path", F.explode("__reach").alias("r"))
    heads = heads.select("host", "path", F.col("r.__host").alias("__host"), F.explode("r.__lengths").alias("__n")).where(F.col("__n") <= F.length("path"))
    heads = heads.withColumn("__head", F.substring(F.col("path"), F.lit(1), F.col("__n")))
    found = _salted(heads, F.concat("host", "path"), table, ["__host", "__head"])
    best = found.groupBy("host", "path").agg(F.max(F.struct((F.length("__host") + F.length("__head")).alias("n"), "__allow", "__host", "__head")).alias("b"))
    return best.select("host", "path", F.concat("b.__host", "b.__head").alias("rule"), F.when(F.col("b.__allow"), ALLOW).otherwise(BLOCK).alias("own"))


def with_rule(rows: DataFrame, by: Column, rules: list[Rule] | DataFrame) -> DataFrame:
    """rows (host, path, ...) with rule and own verdict, null where none fits; `by` deals the rows of one url."""
    if isinstance(rules, DataFrame):
        return _salted(rows, by, fitting_rows(rows, rules), ["host", "path"], "left")
    rule, own = fitting(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "own": own})


def _node(url: Column) -> Column:
    """What stands for a url in the graph: without its fragment, host in lower case; null without a host."""
    host, _ = host_path(url)
    tail = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), "^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(tail == "", "/").otherwise(tail)))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value as written, quoted or not; empty if there is none."""
    form = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, form, k) for k in (1, 2, 3)))


def unescape(text: Column) -> Column:
    """Without the escapes of numbers and of & < > quotes, each read once."""
    held = "\x01"

    def put(out: Column, code: Column) -> Column:
        digits = F.regexp_extract(code, "(?i)^&#x?([0-9a-f]+);$", 1)
        number = F.when(F.lower(F.substring(code, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        known = lambda point: point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        sign = lambda point: F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return let(number, lambda point: F.when(known(point), F.replace(out, code, F.when(point == 38, held).otherwise(sign(point)))).otherwise(out))

    numbers = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit("(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)), x, put)
    out = let(F.replace(text, F.lit("&amp;"), F.lit(held)), numbers)
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.replace(out, F.lit(held), F.lit("&"))


def _without_dots(url: Column) -> Column:
    """url with "." and ".." taken out of its path."""
    step = lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(s)))
    root, tail = F.regexp_extract(url, "^[^:/?#]*://[^/?#]*", 0), F.regexp_extract(url, "[?#].*$", 0)
    parts = F.split(F.regexp_extract(url, "^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/")
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), ends)
    return F.when(url.rlike(r"^[^?#]*/\.{1,2}(/|\?|#|$)"), F.concat(root, F.array_join(kept, "/"), tail)).otherwise(url)


def resolved(base: Column, to: Column) -> Column:
    """The url that a target on a page of the url `base` means."""
    return let(base, lambda x: let(to, lambda y: _resolved(x, y)))


def _resolved(base: Column, to: Column) -> Column:
    root, page = F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0), F.regexp_extract(base, "^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(page, "^[^:/?#]*://[^/]*/(?:.*/)?", 0), F.lit("")), F.concat(root, F.lit("/")))
    within = F.when(to.startswith("/"), F.concat(root, to)).when(to.startswith("?"), F.concat(page, to)).when(to.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), to)).otherwise(F.concat(folder, to))
    return F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to).otherwise(let(within, _without_dots))


#: Comments and elements whose text is no markup; one that isn't closed goes on to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{name}\b.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "textarea", "template"))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b) for every canonical link and meta refresh of the pages' html, as graph nodes; targets are resolved against the page or its base element; comments and scripts hold no links."""
    url, html = F.col("url").cast("string"), F.col("__html")
    pages = pages.select("url", F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)canonical|http-equiv|&#")).select("url", F.regexp_replace("html", HIDDEN, " ").alias("__html"))
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags("link"), lambda x: F.array_contains(F.split(F.lower(unescape(_attribute(x, "rel"))), r"\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda x: F.lower(F.trim(unescape(_attribute(x, "http-equiv")))) == "refresh")
    said = lambda x: F.regexp_extract(unescape(_attribute(x, "content")), r"(?is)^\s*+[0-9.]*+\s*+[;,]?\s*+(?:url\s*=\s*)?+[\"']?([^\"'\s>]+)", 1)
    bare = lambda x: unescape(F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    targets = F.concat(F.transform(canonical, lambda x: F.trim(unescape(_attribute(x, "href")))), F.transform(refresh, lambda x: F.when(x.rlike(r"(?is)\scontent\s*=\s*[\"']"), said(x)).otherwise(bare(x))))
    based = F.trim(unescape(_attribute(F.coalesce(F.get(tags("base"), 0), F.lit("")), "href")))
    found = pages.select(url.alias("url"), based.alias("based"), F.explode(targets).alias("to")).where("to <> ''")
    base = F.when(F.col("based") != "", resolved(F.col("url"), F.col("based"))).otherwise(F.col("url"))
    return found.select(_node(F.col("url")).alias("a"), let(resolved(base, F.col("to")), _node).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages (page_id, url, html); redirects: (source, target) urls."""
    shelf = Shelf(pages.sparkSession)
    url = F.col("url").cast("string")
    host, path = host_path(url)
    judged = with_rule(pages.select("page_id", host.alias("host"), path.alias("path"), _node(url).alias("node")), F.struct("page_id", "node"), rules)
    judged = judged.select("page_id", "host", "path", "rule", "own", F.when(F.col("own").isNull(), F.col("node")).alias("node"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(_node(F.col("source")).alias("a"), _node(F.col("target")).alias("b")).where("a is not null and b is not null"))
    classes = components(shelf, links)
    if classes.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))
    member = F.concat(F.lit("http://"), F.col("node"))
    host, path = host_path(member)
    members = with_rule(classes.select("component", "node", host.alias("host"), path.alias("path")), F.col("node"), rules)
    by_class = members.select("component", F.col("own").alias("said")).groupBy("component").agg(F.max(F.col("said") == ALLOW).alias("allows"), F.max(F.col("said") == BLOCK).alias("blocks"))
    passed = F.when(F.col("allows"), ALLOW).when(F.col("blocks"), BLOCK)
    aliases = shelf.put(classes.join(by_class, "component").select("node", passed.alias("passed")))
    # Pages with a rule of their own have no node; they stay out of the join, where one null key would hold them all.
    own = judged.where("node is null").withColumn("passed", F.lit(None).cast("string"))
    out = judged.where("node is not null").join(aliases, "node", "left").unionByName(own)
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit(default)).alias("verdict"))

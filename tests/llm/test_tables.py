"""Chat formatting, URL filters and the queries' SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioloom.llm import chat, queries, urls

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages conversations".split()


def test_chats_read_back(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", "<sep>\\b\\l: "), (1, 3, "a: b", "####"), (1, 3, "a: b", ""), (2, None, None, None), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (None, 0, "user", "ñ日\n")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(turns)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        want = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        assert got[conv] == (want, [t for role, t in want if role == "assistant"])
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chats_are_linear_arrays(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<"), "id").alias("text"))
    r = chat.format_chats(turns).select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.size("loss_spans").alias("k"), chat.read_loss(F.col("formatted"), F.col("loss_spans"))[1999].alias("last")).first()
    assert (r.n, r.k, r.last) == (3000, 2000, "t<2999")


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.Example.ORG/es/x?q=/en/1#f", None), (2, "http://example.org/en/12", ""), (3, "https://b.com/de/1", ""), (4, "https://b.com/fr/1", ""), (5, "nada", "x"), (6, None, None), (7, "http://x.net", link.format("http://b.com/de/1")),
        (8, "http://y.net/a", link.format("http://b.com/de/1")), (9, "http://z.net/a", '<meta http-equiv="refresh" content="0; url=http://y.net/a">'), (10, "http://w.net/q", link.format("http://b.com/fr/9")), (11, "http://w.net/r", link.format("/q")), (12, "http://badexample.org/es/1", ""), (8, "http://y.net/a", link.format("http://b.com/de/1")),
        (13, "http://v.net/1", link.format("http://y.net/a")), (14, "http://u.net/1", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://v.net/1", "http://s.org/ok")], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[12][2:] == ("org/", "allow")
    assert [got[k][3] for k in (7, 8, 9, 10, 11, 13, 14)] == ["block", "block", "block", "allow", "allow", "block", "allow"]
    got = {r.page_id: r.verdict for r in urls.judge(pages, queries.RULES, redirects).collect()}
    assert [got[k] for k in (7, 8, 9, 13)] == ["allow"] * 4 and got[3] == "block"
    assert urls.judge(pages.limit(0), queries.RULES).count() == 0


def test_every_link_form(spark):
    rows = [
        ('<link rel="canonical" href="/1"><link rel=canonical href=http://b.com/2>', {"x.net/1", "b.com/2"}),
        ('<link rel="alternate" href="/no"><LINK href=\'q?a=1&amp;b=&#50;&#x33;\' rel=\'shortlink Canonical\'>', {"x.net/d/q?a=1&b=23"}),
        ('<link data-rel="canonical" href="/no"><link rel="canonical" href="../up/./z?k=..">', {"x.net/up/z?k=.."}),
        ('<meta http-equiv="refresh" content="0; url=\'e\'"><meta http-equiv=refresh content=5;url=//c.org/f><meta http-equiv="refresh" content="30">', {"x.net/d/e", "c.org/f"}),
        ('<meta content="1; http://b.com/&amp;lt;" http-equiv="Refresh">', {"b.com/&lt;"}),
        ('<base href="http://o.net/p/"><link rel="canonical" href="r"><link rel="canonical" href="?s">', {"o.net/p/r", "o.net/p/?s"}),
        ('<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href=""><link rel="canonical">', set()),
        ('<!-- <link rel="canonical" href="/a"> --><script>s = \'<link rel="canonical" href="/b">\'</script ><STYLE><link rel=canonical href=/c></style><link rel="canonical" href="/d"><!--> <meta http-equiv="refresh" content="0; url=/e">', {"x.net/d"}),
        ('<template><link rel="canonical" href="/a"></template><scripts><link rel="canonical" href="/b"><script><!-- </script> <link rel="canonical" href="/c"><script><link rel="canonical" href="/no">', {"x.net/b", "x.net/c"}),
        ('<link rel="canonical" href="http://b.com/&#241;&#99999999;&#1114112;">', {"b.com/ñ&"}),
    ]
    for k, (html, want) in enumerate(rows):
        pages = spark.createDataFrame([("http://X.net/d/page?q=/a/b", html)], "url string, html string")
        got = urls.page_links(pages).collect()
        assert {r.b for r in got} == want and all(r.a == "x.net/d/page?q=/a/b" for r in got), k
    bare = spark.createDataFrame([("http://x.net?a/b", '<link rel="canonical" href="y">')], "url string, html string")
    assert urls.page_links(bare).first().b == "x.net/y"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, FOLDER).select(want.columns).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want.fetchall()))


def test_components_of_random_graphs(spark):
    """Verdicts over made redirects against a plain walk: allow before block in a class, own rules first, the default elsewhere."""
    rng = random.Random(10)
    names = [f"http://{h}/p{k}" for k in range(30) for h in ("a.com/de", "b.com/fr", "c.net", "d.net", "e.org")]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [("http://c.net/p0", "http://c.net/p0"), (None, names[0]), (names[1], "no url")]
    near = {n: {n} for n in names}
    for a, b in links:
        if a in near and b in near:
            near[a].add(b), near[b].add(a)

    def own(n):
        return {"a.com": "block", "b.com": "allow", "e.org": "allow"}.get(n.split("/")[2])

    def verdict(n):
        seen, stack = {n}, [n]
        while stack:
            stack += (new := near[stack.pop()] - seen)
            seen |= new
        said = {own(m) for m in seen}
        return own(n) or ("allow" if "allow" in said else "block" if "block" in said else "allow")

    pages = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "page_id long, url string, html string")
    redirects = spark.createDataFrame(links, "source string, target string").repartition(5)
    got = {r.page_id: r.verdict for r in urls.judge(pages, queries.RULES, redirects).collect()}
    want = {k: verdict(n) for k, n in enumerate(names)}
    assert got == want and set(want.values()) == {"allow", "block"} and sum(own(n) is None and want[k] == "block" for k, n in enumerate(names)) > 3


def test_rule_tables(spark):
    """Rules as a table against each rule tried in turn: subdomains, ties, empty and repeated paths, odd urls and repeated rows; and very many rules."""
    rng = random.Random(7)
    labels = ["a", "b", "com", "org", "x-y", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "d", "e", "é"]) for _ in range(rng.randint(0, 5)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(150)]
    pages = [(k, f"http://{host()}/{path()}?{path()}") for k in range(400)] + [(k, "http://a.com/d") for k in range(300)] + [(None, "http://a.com/d"), (1, None), (2, "no url"), (3, "http://")]
    rows = spark.createDataFrame([(*p, None, "clash") for p in pages], "page_id long, url string, html string, rule string")
    table = spark.createDataFrame([*rules, rules[0], ("block", None, "/"), ("maybe", "com", "/"), (None, "com", "/")], "verdict string, host string, path string")
    redirects = spark.createDataFrame([("http://q.net/1", "http://a.com/d"), ("http://q.net/2", "http://q.net/1")], "source string, target string")
    more = spark.createDataFrame([(k, f"http://q.net/{k}", None, None) for k in (1, 2, 3)], rows.schema)
    rows = rows.unionByName(more)

    def best(host, path):
        fit = [(len(h + p), v == "allow", h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fit)[2] + max(fit)[3], max(fit)[4]) if fit else (None, None)

    got = [tuple(r) for r in urls.judge(rows, table, redirects).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(got) == len(pages) + 3
    passed = best("a.com", "/d")[1] or best("q.net", "/1")[1] or "allow"
    for page, h, p, rule, verdict in got:
        name, own = best(h, p)
        assert rule == name and verdict == (own or (passed if h == "q.net" and p in ("/1", "/2") else "allow")), (page, h, p)
    few = spark.createDataFrame(rules[:12], table.schema)
    told = lambda found: sorted(repr(tuple(r)) for r in urls.judge(rows, found).select("page_id", "host", "path", "rule", "verdict").collect())
    assert told(few) == told([urls.Rule(*r) for r in rules[:12]])
    assert urls.judge(rows, table.limit(0)).where("rule is not null").isEmpty() and urls.judge(rows.limit(0), table).isEmpty()
    many = spark.range(100_000).selectExpr("if(id % 2 = 0, 'block', 'allow') as verdict", "concat('h', id, '.net') as host", "concat('/', id % 7) as path")
    few = spark.range(1000).selectExpr("id as page_id", "concat('http://www.h', id * 50, '.net/', id * 50 % 7, '/x') as url", "cast(null as string) as html")
    assert urls.judge(few, many).where("rule is not null and verdict = 'block'").count() == 1000

"""Rules against a plain reading of URLs; the template tree on planted hosts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.llm import queries, urltree


def plain(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_for(host, path):
    found = []
    for verdict, rule in queries.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            found.append((len(rule), rule, verdict))
    return max(found)[1:] if found else (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://a.com", "http://a.com/", "https://WWW.Example.COM/en/x?q#f", "https://Example.com/en/", "http://x.example.com/en/1",
    "http://x.www.example.com/en/1", "ftp://net/es/", "http://ünet.NET/es/a", "http://b.net?x/es/", "a://b://c.net/fr/", "http://xnet/fr/", "http://c.net/FR/", "http://\n.net/es/\n?",
]


def judged(spark, rows, **more):
    frame = spark.createDataFrame([(i, u, "j") for i, u in enumerate(rows)], "page_id long, url string, judged string")
    return {r["page_id"]: r["judged"] for r in urltree.judge_urls(frame, queries.RULES, **more).collect()}


def check(url, j):
    host, path = plain(url)
    rule, verdict = rule_for(host, path)
    assert (j["host"], j["path"], j["rule"]) == (host, path, rule), url
    if verdict:
        assert j["verdict"] == verdict


def test_fixed_urls(spark):
    got = judged(spark, URLS)
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        check(url, got[i])
    assert got[0]["verdict"] == "allow" and got[0]["template"] is None


def test_any_url(spark):
    made = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(st.sampled_from("ht:/?#.comnetesENexample"), max_size=30).map(lambda t: "http://" + t))
    def gather(url):
        made.append(url)

    gather()
    got = judged(spark, made)
    for i, url in enumerate(made):
        check(url, got[i])


def test_query(spark, folder):
    urls = {r["page_id"]: r["url"] for r in queries.table(spark, folder, "pages").collect()}
    rows = queries.op5_urls(spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        check(urls[r["page_id"]], r)
        assert r["verdict"] in ("allow", "block")


def planted():
    rows = []
    for i in range(60):
        rows += [
            (f"http://shop.org/item/{i}", 0), (f"http://shop.org/win/{i}", 1), (f"http://shop.org/bonus/{i}", 1), (f"http://shop.org/about/{i}", None),
            (f"http://shop.org/blog/title-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", 0), (f"http://other.org/win/{i}", 0), (f"http://few.org/win/{i}", 1 if i < 2 else None),
        ]
    return rows


def test_planted_tree(spark):
    frame = spark.createDataFrame(planted(), "url string, label int")
    rows = urltree.judge_urls(frame, [], label="label").select("url", "judged.*").collect()
    assert len(rows) == len(planted())
    found = {}
    for r in rows:
        found.setdefault((r["host"], r["template"]), set()).add(r["verdict"])
    assert found["shop.org", "/win/*"] == found["shop.org", "/bonus/*"] == {"block"}
    assert found["shop.org", "/item/*"] == found["shop.org", "/about/*"] == found["other.org", "/win/*"] == {"allow"}
    assert found["few.org", "/win/*"] == {"allow"}  # two labels are too few
    assert found["shop.org", "/blog/*"] == {"allow"} and len(found) == 7
    purity = {(r["host"], r["template"]): r["purity"] for r in rows}
    assert purity["shop.org", "/win/*"] == purity["shop.org", "/bonus/*"]  # merged
    assert purity["shop.org", "/item/*"] != purity["shop.org", "/win/*"]


def test_ties_prefer_blocking(spark):
    frame = spark.createDataFrame([("http://a.com/x",)], "url string")
    got = urltree.judge_urls(frame, [("block", "com/x"), ("allow", "com/x")]).first()["judged"]
    assert got["verdict"] == "block"


@pytest.mark.parametrize("segment, want", [("12", "*"), ("12.html", "*.html"), ("about", "about"), ("a1b2c3d4e5", "*"), ("deadbeef", "*"), ("", ""), ("x" * 40, "*")])
def test_masks(spark, segment, want):
    assert spark.createDataFrame([(segment,)], "s string").select(urltree.masked(urltree.F.col("s"))).first()[0] == want


def test_empty_table(spark):
    assert urltree.judge_urls(spark.createDataFrame([], "url string"), queries.RULES).collect() == []


def test_clashing_columns(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x/1"), (2, "http://example.com/en/2"), (3, None)], "page_id long, url string")
    plain = {r["page_id"]: r["judged"] for r in urltree.judge_urls(urls, queries.RULES).collect()}
    names = ("_u", "_r", "_t_host", "_t_template", "_row", "host", "path", "parts", "judged")
    for r in urltree.judge_urls(urls.selectExpr("*", *[f"'odd' AS {c}" for c in names]), queries.RULES).collect():
        assert all(r[c] == "odd" for c in names[:-1]) and r["judged"] == plain[r["page_id"]]

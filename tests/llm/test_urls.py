from clademark.llm import urls

PAGES, RULES = "page_id long, url string, html string, host string", "host string, path string, verdict string, page_id int"


def judged(spark, pages, redirects=None):
    p = spark.createDataFrame([(*x, "") for x in pages], PAGES)
    r = spark.createDataFrame([(*x, 0) for x in urls.RULES], RULES)
    return {x.page_id: x for x in urls.judge(p, r, redirects).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.COM/en/x?y", None), (2, "https://www.example.com/en/", ""), (3, "http://x.net/es/1", ""), (4, "http://x.net/esp", ""),
        (5, None, None), (6, "no scheme", ""), (7, "http://net", ""), (8, "x://com/", ""), (9, "http://notexample.com/en/", ""), (10, "http://a?://b/c", ""), (11, "http://example.com#/en/", ""),
    ])
    assert [got[i].rule for i in range(1, 12)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, "com/", "com/", None, None]
    assert [got[i].verdict for i in range(1, 12)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/x") and (got[5].host, got[5].path) == ("", "") and (got[10].host, got[10].path) == ("a", "")


def test_blocks_reach_aliases_but_not_allowed_pages(spark):
    link = lambda u: f"<LINK href='{u}' rel=\"canonical\">"
    move = "<meta http-equiv=refresh content=\"0; url=http://d.org/4\">"
    pages = [(1, "http://a.org/1", link("http://b.org/2/")), (2, "https://b.org/2#x", link("http://c.net/fr/3")), (3, "http://c.net/fr/3", move), (4, "http://d.org/4", ""), (5, "http://e.com/", link("http://a.org/1")), (6, "http://f.org/", link("http://g.org/")), (7, "http://h.org/", "")]
    got = judged(spark, pages)
    assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "block", "block", "allow", "allow", "allow"]
    more = spark.createDataFrame([("http://h.org", "http://f.org/"), ("http://f.org/", "http://d.org/4")], "source string, target string")
    assert judged(spark, pages, more)[7].verdict == "block"


def test_empty(spark):
    assert judged(spark, []) == {}


def test_targets_of_any_form(spark):
    link = lambda u, more="": f"<link {more} rel=canonical href='{u}'>"
    bad = "http://c.net/fr/3"
    pages = [
        (1, bad, ""), (2, "https://c.net/fr/a/b?x#y", ""),  # blocked by rule
        (10, "http://q.org/r", "<meta http-equiv=refresh content='0; url=//c.net/fr/3'>"),
        (11, "http://r.org/x/y", link("/down")), (12, "http://r.org/down", link(bad)),
        (13, "http://r.org/x/z", link("y")), (14, "http://r.org/x/v/w", link("../y#f")), (15, "http://s.org/2#z", link("?a=1&amp;b=2")),
        (16, "http://s.org/1", link("http://s.org/2?a=1&amp;b=2")), (17, "http://s.org/2?a=1&b=2", link(bad)),
        (18, "http://t.org/1", link(bad, "title='" + "t" * 5000 + "'")), (19, "http://u.org/1", link("http://u.org/" + "l" * 3000)), (20, "http://u.org/" + "l" * 3000, link(bad)),
        (21, "http://v.org/a/1", "<base href='http://r.org/x/'>" + link("y")),
        (30, "http://w.org/login", link("/login?next=http://c.net/fr/3")), (31, "http://w.org/m", link("mailto:a@c.net")), (32, None, link("/fr/3")), (33, "no scheme", link(bad)), (34, "no host", ""),
    ]
    got = judged(spark, pages)
    assert [i for i in range(10, 22) if got[i].verdict != "block"] == []
    assert [i for i in range(30, 35) if got[i].verdict != "allow"] == []


def test_blocks_of_addresses_without_a_page(spark):
    link = lambda u: f"<link rel=canonical href='{u}'>"
    pages = [
        (1, "http://a.org/1", link("http://example.com/en/")), (2, "http://a.org/2", link("http://a.org/1")), (3, "http://www.example.com/en/3", link("http://a.org/1")),
        (4, "http://b.org/1", link("http://www.example.com/en/4")), (5, "http://d.org/1", link("http://gone.org/")), (6, "http://e.org/1", ""),
    ]
    got = judged(spark, pages)
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "allow"]
    more = spark.createDataFrame([("http://gone.org", "http://x.net/es/1"), ("http://e.org/1", "http://e.org/2")], "source string, target string")
    got = judged(spark, pages, more)
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "block", "allow"] and len(got) == 6


def test_repeated_rows_ties_and_very_long_pages(spark):
    link = "<p>" * 200000 + "<link rel=canonical href='http://example.com/en/b'>"
    rows = [(1, "http://a.com/x", link), (1, "http://a.com/x", link), (2, "http://b.org/", link), (2, "http://b.org/", None)]
    p = spark.createDataFrame([(*x, "") for x in rows], PAGES)
    # Two rules of one length and place: allow wins.
    r = spark.createDataFrame([(*x, 0) for x in [*urls.RULES, ("example.com", "/en/", "allow")]], RULES)
    got = sorted((x.page_id, x.verdict, x.rule) for x in urls.judge(p, r).collect())
    assert got == [(1, "allow", "com/"), (1, "allow", "com/"), (2, "allow", None), (2, "allow", None)]
    r = spark.createDataFrame([(*x, 0) for x in urls.RULES], RULES)
    got = sorted((x.page_id, x.verdict, x.rule) for x in urls.judge(p, r).collect())
    assert got == [(1, "allow", "com/"), (1, "allow", "com/"), (2, "block", None), (2, "block", None)]

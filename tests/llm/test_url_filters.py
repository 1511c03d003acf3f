from lectern.llm import url_filters
from lectern.llm.components import components
from lectern.llm.queries import PAGE_RULES


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, PAGE_RULES).collect()}


def test_rules(spark):
    got = judged(spark, [(1, "HTTP://WWW.Example.ORG/es/q?x#y", None), (2, "http://example.org/en/12", ""), (3, "x://org", ""), (4, "x://org/", ""),
                         (5, "x://notcom/fr/", ""), (6, "x://a.com/fr/", ""), (7, "x://a.com/de/", ""), (8, None, None), (9, "no scheme", ""),
                         (10, "a://b?c://d.com/de/", ""), (11, "x://É.org/É", ""), (12, "x://a.com/DE/", "")])
    assert got == {
        1: ("www.example.org", "/es/q", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("org", "", None, "allow"), 4: ("org", "/", "org/", "allow"), 5: ("notcom", "/fr/", None, "allow"), 6: ("a.com", "/fr/", "com/fr/", "allow"),
        7: ("a.com", "/de/", "com/de/", "block"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("b", "", None, "allow"),
        11: ("É.org", "/É", "org/", "allow"), 12: ("a.com", "/DE/", None, "allow")}


def test_blocks_reach_aliases_but_not_those_with_an_allowed_one(spark):
    canonical = lambda u: f"<link rel='canonical' href='{u}'>"
    got = judged(spark, [
        (1, "http://a.com/de/x", canonical("http://b.net/y")), (2, "https://b.net/y#q", canonical("http://c.net/z")), (3, "http://c.net/z", None),
        (4, "http://d.net/1", '<meta http-equiv="refresh" content="0; url=//x.com/de/1">'), (5, "http://e.net/1", canonical("/2?a=1&amp;b=2")),
        (6, "http://e.net/2?a=1&b=2", canonical("http://q.com/de/")), (7, "http://f.net/1", canonical("http://g.com/de/1")),
        (8, "http://f.net/2", canonical("http://f.net/1")), (9, "http://f.net/3", canonical("http://f.net/2") + canonical("http://h.org/")),
        (10, "http://i.net/", canonical("relative"))])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow",
                                                 9: "allow", 10: "allow"}


def test_targets_of_every_form_are_resolved(spark):
    url = "http://A.net/dir/sub/page.html?x=1#f"
    want = {
        "page2.html": "a.net/dir/sub/page2.html", "./p": "a.net/dir/sub/p", "../p": "a.net/dir/p", "../../../p": "a.net/p", "..": "a.net/dir/",
        "../..": "a.net/", ".": "a.net/dir/sub/", "?id=3": "a.net/dir/sub/page.html?id=3", "q/?u=../y": "a.net/dir/sub/q/?u=../y", "/r/../s": "a.net/s",
        "/go?u=https://x.org/": "a.net/go?u=https://x.org/", "p?u=https://x.org/": "a.net/dir/sub/p?u=https://x.org/", "HTTPS://X.org/P": "x.org/P",
        "//x.org/./p": "x.org/p", "x.html#a:b": "a.net/dir/sub/x.html", "mailto:a@b.c": None, "#top": None}
    forms = ["<link rel=canonical href='{}'>", "<LINK href=\"{}\" rel='alternate canonical'/>", "<link rel=\"Canonical\n next\" href={}>",
             '<meta http-equiv="refresh" content="0; url={}">']
    rows = [(url, form.format(href)) for href in want for form in forms]
    other = ["<link rel='canonical-x' href='no'>", "<link rel=alternate href='no'>", "<link rel='notcanonical' href='no'>"]
    found = url_filters.alias_links(spark.createDataFrame(rows + [(url, o) for o in other], "url string, html string")).collect()
    assert {r.a for r in found} == {"a.net/dir/sub/page.html?x=1"}
    assert sorted(r.b for r in found) == sorted(k for k in want.values() if k for _ in forms)
    bare = url_filters.alias_links(spark.createDataFrame([("x://b.net", forms[0].format("p")), ("no host", forms[0].format("p"))], "url string, html string"))
    assert [(r.a, r.b) for r in bare.collect()] == [("b.net", "b.net/p")]


def test_blocks_reach_relative_aliases(spark):
    canonical = lambda u: f"<link rel='alternate canonical' href='{u}'>"
    got = judged(spark, [(1, "http://a.com/de/x", canonical("../en/y")), (2, "http://a.com/en/y", canonical("?p=1")), (3, "http://a.com/en/y?p=1", None),
                         (4, "http://c.net/1", canonical("/go?u=https://a.com/de/")), (5, "http://c.net/go?u=https://a.com/de/", None)])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (202, 201), (203, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 204)}


def test_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x://a.com/de/", None)] * 2, "page_id long, url string, html string")
    assert url_filters.judge(df, PAGE_RULES).count() == 2
    assert url_filters.judge(df.where("false"), PAGE_RULES).collect() == []

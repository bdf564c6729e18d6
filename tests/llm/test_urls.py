"""URL rules and trust over a small link graph."""

from spendtide.llm import urls

PAGE = "page_id bigint, url string, html string"
RULES = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("bad.org/", "block"), urls.Rule("good.org/", "allow")]


def judged(spark, rows, rules=RULES, **options):
    out = urls.judge_urls(spark.createDataFrame(rows, PAGE), urls.rule_table(spark, rules), **options)
    return {r.page_id: r for r in out.collect()}


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)


def test_hosts_paths_and_longest_rule(spark):
    cases = {
        1: ("HTTP://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://a.example.net/EN/", "a.example.net", "/EN/", "net/", "block"),
        3: ("http://notexample.net", "notexample.net", "", None, "allow"),
        4: ("x://net/?q", "net", "/", "net/", "block"),
        5: ("http://planet/", "planet", "/", None, "allow"),
        6: ("no scheme", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("a://b#c://d/e", "b", "", None, "allow"),
        9: ("", "", "", None, "allow"),
        10: ("http://É.net/a", "É.net", "/a", "net/", "block"),
    }
    got = judged(spark, [(i, c[0], None) for i, c in cases.items()])
    for i, (_, *want) in cases.items():
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == want, i


def plain(seeds, edges, rounds):
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    base = {h: x * 15 // 100 for h, x in seeds.items()}
    score = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for s, d, n in edges:
            if s in score:
                new[d] = new.get(d, 0) + score[s] * n * 85 // (out[s] * 100)
        score = new
    return score


def test_trust_flows_along_links_and_distrust_back(spark):
    rows = [
        (1, "http://good.org/", link("a.com", "b.com", "b.com")),
        (2, "http://a.com/", link("c.com")),
        (3, "http://b.com/", link("bad.org", "bad.org", "a.com")),
        (4, "http://c.com/", "<A HREF = '//good.org/?z'> <a href=//self.com> <a href='/local'>"),
        (5, "http://farm.com/", link(*["bad.org"] * 9)),
        (6, "http://bad.org/", link("farm.com")),
        (7, "http://alone.com/", ""),
    ]
    got = judged(spark, rows, rounds=5)
    edges = [("good.org", "a.com", 1), ("good.org", "b.com", 2), ("a.com", "c.com", 1), ("b.com", "bad.org", 2), ("b.com", "a.com", 1),
             ("c.com", "good.org", 1), ("c.com", "self.com", 1), ("farm.com", "bad.org", 9), ("bad.org", "farm.com", 1)]
    trust = plain({"good.org": urls.UNIT}, edges, 5)
    distrust = plain({"bad.org": urls.UNIT}, [(d, s, n) for s, d, n in edges], 5)
    for r in got.values():
        assert (r.trust, r.distrust) == (trust.get(r.host, 0), distrust.get(r.host, 0)), r.host
    assert got[5].verdict == "block" and got[7].verdict == "allow" and got[2].verdict == "allow"
    assert got[6].verdict == "block" and got[1].verdict == "allow"


def test_rows_stay_and_names_do_not_clash(spark):
    rows = [(None, "http://a.net/", None), (1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (2, "u" * 200_000, "<p>" * 50_000)]
    df = spark.createDataFrame([(*r, "h", "p", "r", 5) for r in rows], PAGE + ", host string, path string, rule string, trust int")
    out = urls.judge_urls(df, urls.rule_table(spark, RULES)).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in out) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://a.net/", None)], rules=[])[1].verdict == "allow"

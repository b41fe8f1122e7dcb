"""URL verdicts: rules against trying each, segmentation against all splits, naive Bayes against plain counting."""

import math
import re
from collections import Counter
from itertools import combinations

import pytest

from strata.llm import queries
from strata.llm import url_filter as uf

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no scheme/a", "://", "http://", "http://?q", "http://#f", "http:///p/q", "http://COM/x", "http://a.com", "http://a.com/", "http://xcom/", "HTTP://WWW.Example.COM/en/1?x=/y#z", "http://example.com/en/",
    "http://example.com/en", "http://sub.www.example.com/en/a", "http://m.example.com/en/a", "http://example.com/EN/a", "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://net/fr/b", "http://a.b://c.com/d",
    "http://cheappills.org/1", "http://cheap-pills.org/casino?x", "https://Ünï.org/é/Ä", "http://" + "a." * 3000 + "com/x", "http://x.org/" + "y" * 50_000, "http://user@a.com:80/x", "http://casino.org/win/win", "http://casinowin.org/win", "http://win.org/win/farm",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


@pytest.fixture
def pages(spark):
    text = b"The cheap pills cheap pills casino win farm. <b>spam</b> <script>never</script> www.cheappills.org &amp; the cat".decode()
    rows = [(i if i % 7 else None, u, [None, "", text, text * 3, "<" * 1000, "<script" * 500 + "x"][i % 6]) for i, u in enumerate(URLS)]
    return rows + rows[9:12]


def test_rules_and_scores_by_brute_force(spark, pages):
    df = spark.createDataFrame(pages, PAGES)
    got = sorted(map(tuple, uf.judge_urls(df).collect()), key=str)
    costs, total = uf.unigram_costs(uf.unigrams(df))
    assert {"cheap", "pills", "casino", "win", "cat"} <= costs.keys() and not {"never", "cheappills", "amp", "script"} & costs.keys()
    tokens = uf.Tokens(costs, total)
    rows = [(p, *parts(u)) for p, u, _ in pages]
    found = [tokens(h, p) for _, h, p in rows]
    block = [any(t[2:] in uf.SEEDS for t in ts) for ts in found]
    n = {v: Counter(t for ts, b in zip(found, block, strict=True) if b == v for t in ts) for v in (True, False)}
    size = len(n[True] | n[False]) + 1
    odds = lambda t: math.log((n[True][t] + 1) / (n[True].total() + size)) - math.log((n[False][t] + 1) / (n[False].total() + size))
    prior = math.log((sum(block) + 1) / (len(block) - sum(block) + 1))
    want = []
    for (page, h, p), ts in zip(rows, found, strict=True):
        rule, verdict = rule_of(h, p, uf.RULES)
        score = prior + sum(map(odds, ts))
        want.append((page, h, p, rule, verdict or ("block" if score > 0 else "allow"), score))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], abs_tol=1e-6, rel_tol=1e-9) for g, w in zip(got, want, strict=True))
    verdict = {r[1]: r[4] for r in got}
    assert verdict["cheappills.org"] == verdict["casinowin.org"] == "block" and verdict["x.org"] == "allow"
    joined = sorted(map(tuple, uf.judge_urls(df, limit=0).collect()), key=str)
    assert joined == got


def test_longest_rule_wins(spark, pages):
    """Many rules, also ones without a path, repeated ones, a null one; by look-up and by join."""
    rules = [("com/", "allow"), ("a.com", "block"), ("a.com/", "allow"), ("net", "block"), ("x.net/fr", "allow"), ("example.com/en/", "block"), ("a.com/", "block"), (None, "block"), ("", "allow")]
    df, table = spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, "rule string, verdict string")
    known = [(r, v) for r, v in rules if r is not None and (r, v) != ("a.com/", "allow")]
    for limit in (None, 0):
        for r in uf.judge_urls(df, table, limit=limit).collect():
            rule, verdict = rule_of(r.host, r.path, known)
            assert r.rule == rule and (rule is None or r.verdict == verdict), (r, rule)


def test_likeliest_segmentation():
    costs, total = {"cheap": 2.0, "pills": 3.0, "che": 1.5, "ap": 2.5, "p": 4.0, "ills": 2.0, "a": 1.0}, math.log(1000)

    def cost(w):
        return costs.get(w, total + math.log(10) * (len(w) - 1))

    for name in ("cheappills", "cheapills", "pillsx", "xyz", "a", "aaa", "", "zzcheapzz"):
        cuts = [c for n in range(len(name)) for c in combinations(range(1, len(name)), n)] or [()]
        splits = [[name[i:j] for i, j in zip((0, *c), (*c, len(name)), strict=True)] for c in cuts] if name else [[]]
        got = uf.segment(name, costs, total)
        assert "".join(got) == name and math.isclose(sum(map(cost, got)), min(sum(map(cost, s)) for s in splits), abs_tol=1e-9)


def test_given_labels(spark):
    """Labels in place of seeds; words run together in an unseen host count as those of seen ones."""
    html = "good news daily offers bad deals " * 5
    df = spark.createDataFrame([(1, "http://baddeals.org/x", html), (2, "http://goodnews.org/x", html), (3, "http://daily.org/x", html)], PAGES)
    seen = spark.createDataFrame([(f"http://{w}{i}.org/x", v) for w, v in (("bad-deals", "block"), ("bad", "block"), ("good-news", "allow"), ("daily-news", "allow")) for i in range(5)] + [("http://odd.org", None)], "url string, verdict string")
    assert {r.page_id: r.verdict for r in uf.judge_urls(df, labelled=seen).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_the_table(spark, data):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.op12_url_filter(spark, data).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.host, r.path) == parts(pages[r.page_id])
        rule, verdict = rule_of(r.host, r.path, uf.RULES)
        assert r.rule == rule and (rule is None or r.verdict == verdict)
        if rule is None:
            assert r.verdict == ("block" if r.score > 0 else "allow")


def test_empty_table(spark):
    assert uf.judge_urls(spark.createDataFrame([], PAGES)).count() == 0

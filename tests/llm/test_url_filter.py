import random
from collections import Counter
from itertools import combinations

import pytest

from railwatch.llm import queries, url_filter

SMALL = "/root/testdata/sf0.01"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :].split("#")[0].split("?")[0]
    return host.translate(LETTERS), path


def rule_of(host, path):
    fits = [
        (len(h + p), h + p, verdict)
        for verdict, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls, first=0):
    rows = [(first + i, u, "<html>", "x", 1.0) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, confidence double")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD = [
    None,
    "",
    "no scheme",
    "http://",
    "http://NET",
    "http://NET/",
    "https://a.B.Net/x?y#z",
    "ftp://planet/de/",
    "http://example.net/en/1",
    "http://www.example.net/en",
    "http://www.example.net/en/?q=/de/",
    "http://x.example.com/de/#",
    "http://example.com?/de/",
    "http://example.com#/de/",
    "http://ÀÉ.org/fr/",
    "http://org/fr/x",
    "http://a://b.net/c",
    "http://a.net\n/x",
    "HTTP://example.org/FR/",
    "x" * 50_000 + "://a.net/" + "y/" * 20_000,
    "http://user@a.net:80/x",
]


def test_hosts_paths_and_fixed_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, [*ODD, "http://a.net/"]), labels(spark, [])).collect()}
    for i, url in enumerate([*ODD, "http://a.net/"]):
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def mined_by_counting(urls, bad):
    """Smallest token sets that enough bad rows hold and that are surely bad, by counting all sets; tokens with equal rows as one."""
    rows = {}
    for number, tokens in enumerate(urls):
        for token in set(tokens):
            rows.setdefault(token, set()).add(number)
    name = {t: min(u for u in rows if rows[u] == rows[t]) for t in rows}
    together, harmful = Counter(), Counter()
    for tokens, is_bad in zip(urls, bad):
        items = sorted({name[t] for t in tokens})
        for n in range(1, len(items) + 1):
            for held in combinations(items, n):
                together[held] += 1
                harmful[held] += is_bad
    sure = {i: harmful[i] / together[i] for i in together if harmful[i] >= url_filter.MIN_ROWS}
    sure = {i: c for i, c in sure.items() if c >= url_filter.MIN_CONFIDENCE}
    return {i: c for i, c in sure.items() if not any(set(j) < set(i) for j in sure)}


def rules_of(spark, rows):
    mined, _ = url_filter.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    return {tuple(r["items"]): r.confidence for r in mined.collect()}


@pytest.fixture(scope="module")
def labelled(spark):
    urls = [f"http://{'pills' if i % 3 == 0 else 'books'}.shop/{'buy' if i % 2 else 'read'}/{i}" for i in range(400)]
    marks = [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(400)]
    return urls, marks


def test_mined_rules_equal_counting(spark, labelled):
    urls, marks = labelled
    got = rules_of(spark, [(u, m[1] == 0) for u, m in zip(urls, marks)])
    tokens = [[f"host:{u.split('/')[2].split('.')[0]}", "host:shop", f"path:{u.split('/')[3]}"] for u in urls]
    assert got == pytest.approx(mined_by_counting(tokens, [m[1] == 0 for m in marks]))
    assert got


def test_as_many_bad_rows_make_a_rule_in_any_table(spark):
    urls = [(f"http://pills.shop/buy/{i}", True) for i in range(url_filter.MIN_ROWS)]
    urls += [(f"http://few.shop/buy/{i}", True) for i in range(url_filter.MIN_ROWS - 1)]
    for others in (0, 8_000):
        rules = rules_of(spark, urls + [(f"http://books.shop/read/{i}", False) for i in range(others)])
        assert rules[("host:pills",)] == 1.0
        assert not any("host:few" in items for items in rules)
        assert (("host:shop",) in rules) == (not others)


def test_random_tables_equal_counting(spark):
    draw = random.Random(3)
    for _ in range(3):
        drawn = [[w for w in "abcdef" if draw.random() < 0.5] for _ in range(300)]
        bad = [("a" in t and "b" in t or "c" in t and "d" in t) and draw.random() < 0.8 for t in drawn]
        rows = [("http://h/" + "/".join(t), b) for t, b in zip(drawn, bad)]
        want = mined_by_counting([["host:h", *(f"path:{w}" for w in t)] for t in drawn], bad)
        assert rules_of(spark, rows) == pytest.approx(want) and want


def test_many_tokens_together_make_one_rule(spark):
    together = "/".join(f"t{i}" for i in range(40))
    rows = [(f"http://a/{together}/{i}", True) for i in range(25)] + [(f"http://a/x/{i}", False) for i in range(100, 150)]
    assert rules_of(spark, rows) == {("path:t0",): 1.0}
    table = pages(spark, [u for u, _ in rows] + ["http://b/t17", "http://b/t40"])
    got = {r.page_id: r.verdict for r in url_filter.judge(table, labels(spark, [(i, int(i >= 100), 0) for i in range(150)])).collect()}
    assert [got[i] for i in (0, 24, 25, 74, 75, 76)] == ["block", "block", "allow", "allow", "block", "allow"]


def test_null_and_repeated_ids_and_ties(spark):
    rows = [("http://a.b/1", True)] * 20 + [("http://c/d", True)] * 20
    marked = spark.createDataFrame([(None, u, "x") for u, _ in rows], "page_id long, url string, html string")
    assert [r.verdict for r in url_filter.judge(marked, labels(spark, [])).collect()] == ["allow"] * 40
    assert set(rules_of(spark, rows)) == {("host:a",), ("host:c",)}


def test_combination_blocks(spark, labelled):
    urls, marks = labelled
    more = ["http://pills.shop/buy/9999", "http://pills.shop/read/9999", "http://x.pills.shop/buy/?a=b", "http://pills.net/buy/1", None]
    marks = [*marks, (3, 1, 0), (None, 0, 1), (7, None, None), (9999, None, None)]
    table = pages(spark, urls + more + [more[0]])
    got = url_filter.judge(table, labels(spark, marks)).collect()
    assert len(got) == len(urls) + 6
    verdicts = {r.page_id: r.verdict for r in got}
    assert [verdicts[400 + i] for i in range(6)] == ["block", "allow", "block", "block", "allow", "block"]
    assert {r.mined_rule for r in got if r.mined_rule} == {"host:pills path:buy"}


def test_no_pages(spark):
    assert url_filter.judge(pages(spark, []), labels(spark, [(1, 0, 0)])).count() == 0


def test_query(spark):
    got = queries.op2_url_filters(spark, SMALL).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))

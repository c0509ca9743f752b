import os
import random
import re

import pytest

from pagewright.llm.queries import RULES
from pagewright.llm.url_templates import KINDS, SHAPES, Templates, judge_urls, template_tree

DATA = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, host string, path string, rule int, template string"


def split(url):
    if "://" not in (url or ""):
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    rows = judge_urls(pages, RULES).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        rule = rule_for(*split(urls[r.page_id]), RULES)
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")


def test_addresses(spark):
    urls = ["http://A.COM", "x://a.com?q=/en/", "http://h.net#f/es/", "http://É.example.COM/EN/", "no scheme", None, "", "http://", "http:///p", "a://b://c/d", "http://xcom/", "http://www.example.com/en/x", "http://a.net/es/\n?x", "https://u:p@h.example.com:80/en/y"]
    rows = [(i, u, "", "", 1, "") for i, u in enumerate(urls)]
    found = judge_urls(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    for r in found:
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule_for(*split(urls[r.page_id]), RULES))


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://shop.org/{'ads' if i % 2 else 'guide'}/{i}.html", "", "", 1, "") for i in range(200)]
    rows += [(1000 + i, f"http://shop.org/{'promo' if i % 2 else 'news'}/{i}", "", "", 1, "") for i in range(100)]
    rows += [(5000, "http://lonely.org/x/y/z/1/2/3/4", "", "", 1, ""), (5000, "http://lonely.org/x/y/z/1/2/3/4", "", "", 1, "")]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(100)] + [(1000 + i, i % 2 == 1) for i in range(40)], "page_id bigint, bad boolean")
    pages = spark.createDataFrame(rows, SCHEMA)
    found = judge_urls(pages, {}, labels=labels).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert by_id[151].verdict == "block" and by_id[150].verdict == "allow"
    assert by_id[1051].verdict == "block" and by_id[1050].verdict == "allow"
    assert by_id[151].template == by_id[153].template != by_id[150].template and "{n}" in by_id[151].template
    assert by_id[5000].verdict == "allow" and by_id[5000].template.endswith("**")
    # Branches that labels don't tell apart merge: {n}.html under one node, {n} under the other.
    same = judge_urls(pages.filter("page_id >= 1000 and page_id < 2000"), {}, Templates(min_pages=2)).collect()
    assert {r.template for r in same} == {"shop.org/(news|promo)/{n}"} and {r.verdict for r in same} == {"allow"}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), RULES).collect() == []


def test_small_sections_and_deep_segments(spark):
    # 100 sections of 1 % of a host, every second purely bad; and sections told apart at depth 7.
    rows = [(i, f"http://h.org/section{i % 100}/{i}.html", "", "", 1, "") for i in range(5000)]
    rows += [(9000 + i, f"http://deep.org/a/b/c/d/e/{'ads' if i % 2 else 'guide'}/{i}", "", "", 1, "") for i in range(200)]
    labels = [(i, i % 2 == 1) for i in range(2500)] + [(9000 + i, i % 2 == 1) for i in range(100)]
    labels = spark.createDataFrame(labels, "page_id bigint, bad boolean")
    found = judge_urls(spark.createDataFrame(rows, SCHEMA), {}, labels=labels).collect()
    assert len(found) == len(rows)
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in found)


def shape(segment):
    stem, extension = re.fullmatch(r"(.*?)(\.[a-zA-Z]{2,5})?", segment).groups()
    for name, pattern in SHAPES:
        if re.search(pattern, stem):
            return name + (extension or "")
    return segment


def chi(bad, n, other_bad, other_n):
    if not n or not other_n or (bad + other_bad) in (0, n + other_n):
        return 0.0
    p = (bad + other_bad) / (n + other_n)
    return (bad / n - other_bad / other_n) ** 2 / (p * (1 - p) * (1 / n + 1 / other_n))


def kind(steps, at):
    step = steps[at] if at < len(steps) else "$"
    return next((i for i, k in enumerate(KINDS[:-1]) if step.startswith(k)), len(KINDS) - 1)


def totals(rows, level):
    pages, n, bad = (sum(r[c] for r in rows) for c in (2, 3, 4))
    return pages, n, bad, [sum(r[2] for r in rows if kind(r[1], level + 1) == i) for i in range(len(KINDS))]


def by_hand(rows, level, purity, cfg, out):
    """``rows`` of one node: (path, steps, pages, labelled, bad); fills ``out`` path -> purity."""
    if len(rows) < 2 or sum(r[2] for r in rows) < cfg.min_pages or max(len(r[1]) for r in rows) <= level:
        out.update({r[0]: purity for r in rows})
        return
    _, node_n, node_bad, _ = totals(rows, level)
    children, bins = {}, {}
    for r in rows:
        children.setdefault(r[1][level] if level < len(r[1]) else "$", []).append(r)
    for child in children.values():
        pages, n, bad, follows = totals(child, level)
        if pages < cfg.min_pages:
            key = (0, -2)
        else:
            told = n and chi(bad, n, node_bad - bad, node_n - n) > cfg.chi_square
            share = (bad + cfg.smoothing * purity) / (n + cfg.smoothing)
            key = (follows.index(max(follows)) + 1, -1 if not n else 1 + int(share * cfg.bins) if told else 0)
        bins.setdefault(key, []).append(child)
    groups, before = [], None
    for key in sorted(bins):
        pages, n, bad, follows = now = totals(sum(bins[key], []), level)
        if before is not None:
            old_key, (p_pages, p_n, p_bad, p_follows) = before
            shapes = 0.0
            for a, b in zip(follows, p_follows):
                for x, size in ((a, pages), (b, p_pages)):
                    e = (a + b) * size / (pages + p_pages)
                    shapes += (x - e) ** 2 / e if e else 0
            apart = old_key[1] == -2 or (n > 0) != (p_n > 0) or chi(bad, n, p_bad, p_n) > cfg.chi_square
            apart = apart or shapes > cfg.chi_square_shapes
        if before is None or apart:
            groups.append([])
        groups[-1].append(key)
        before = key, now
    for keys in groups:
        branch = [r for k in keys for child in bins[k] for r in child]
        weight = max(1, sum(len(bins[k]) for k in keys if k[1] > 0)) * cfg.smoothing
        _, n, bad, _ = totals(branch, level)
        mine = purity if (n, bad) == (node_n, node_bad) else (bad + weight * purity) / (n + weight)
        by_hand(branch, level + 1, mine, cfg, out)


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_by_hand(spark, seed):
    rng, cfg = random.Random(seed), Templates(min_pages=3)
    words = ["ads", "news", "shop", "x1y2z3w4", "12", "2024-01-02", "deadbeef01", "blog", "q"]
    paths = {}
    for _ in range(1500):
        path = "".join("/" + rng.choice(words) + rng.choice(["", "", ".html", str(rng.randrange(4))]) for _ in range(rng.choice([0, 1, 2, 3, 6])))
        n = rng.choice([0, 0, 1, 4])
        paths[(rng.choice("ab"), path)] = (4, n, n if "ads" in path else rng.randint(0, n) // 3)
    table = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, path string, pages bigint, labelled bigint, bad bigint")
    found = {(r.host, r.path): r.purity for r in template_tree(table, cfg).collect()}
    prior = sum(v[2] for v in paths.values()) / sum(v[1] for v in paths.values())
    for host in "ab":
        rows = [(p, [shape(s) for s in p.split("/") if s], *v) for (h, p), v in paths.items() if h == host]
        _, n, bad, _ = totals(rows, 0)
        out = {}
        by_hand(rows, 0, (bad + cfg.smoothing * prior) / (n + cfg.smoothing), cfg, out)
        assert out.keys() == {p for h, p in found if h == host}
        for p, purity in out.items():
            assert found[host, p] == pytest.approx(purity), (host, p)

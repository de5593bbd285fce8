import random
import time

import numpy as np
import pytest

from tablewright.llm import url_filter
from tablewright.llm.url_filter import OP9_RULES, Rule, UrlFilter

URLS = [
    "https://www.example.com/en/a?x=1", "http://EXAMPLE.com/en/", "http://example.com/e", "http://a.b.example.com/en/z#t", "https://x.net/es/1", "https://x.net/fr", "http://net/fr/2", "http://com/", "http://com", "ftp://notcom/x",
    None, "", "no scheme.com/en/", "http://", "://example.com/en/", "http://a.com?q=/en/", "http://a.org/en/", "x://y://example.com/en/", "http://ex\u00c4mple.com/\n/en/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(r.host + r.path), len(r.host), r) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, default=None, key=lambda x: x[:2])
    return host, path, best and best[2].host + best[2].path, best[2].action if best else "allow"


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, keys string")
    frame = spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    found = UrlFilter(spark, frame, pages, **options)
    return found, {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.judge(pages).collect()}


def test_rules(spark):
    _, got = judged(spark, [*URLS, *URLS[:3]], OP9_RULES)
    assert got == {i: brute(u, OP9_RULES) for i, u in enumerate([*URLS, *URLS[:3]])}


@pytest.mark.parametrize("limit", [32 << 20, 200])
def test_long_lists_stay_exact(spark, limit):
    """Also in shards, and with levels that must undo false positives."""
    draw = random.Random(1)
    name = lambda: ".".join(draw.choice("abcdefghij") + str(draw.randrange(40)) for _ in range(draw.randrange(1, 4)))
    rules = {(r.host, r.path): r for r in (Rule(draw.choice(["allow", "block"]), name(), draw.choice(["", "/", "/a", "/bb/"])) for _ in range(900))}.values()
    urls = [f"http://{name()}{draw.choice(['', '/', '/a', '/bb/c', '/x'])}" for _ in range(1500)]
    found, got = judged(spark, urls, list(rules), max_filter_bytes=limit)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert (found.shards > 1) == (limit == 200)
    assert max(map(len, found.cascades.values())) > 1


def test_cascade_on_keys_alone():
    draw = np.random.default_rng(0)
    keys = draw.integers(-(2**62), 2**62, (4000, 2))
    inside, outside, levels = keys[:1000], keys[1000:], []
    members, others = inside, outside
    while len(members):
        bits = np.zeros(1250, dtype=np.uint8)
        at = url_filter.positions(members[:, 0], members[:, 1], len(levels) + 1, 10_000).ravel()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        levels.append(url_filter.Level(len(levels) + 1, 10_000, bits))
        members, others = others[levels[-1].passes(others[:, 0], others[:, 1])], members
    assert url_filter.listed(levels, keys[:, 0], keys[:, 1]).tolist() == [True] * 1000 + [False] * 3000


def test_empty_tables(spark):
    _, got = judged(spark, [], OP9_RULES)
    assert got == {}
    _, got = judged(spark, URLS[:3], [])
    assert {v[2:] for v in got.values()} == {(None, "allow")}


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 16_000 + "example.com/en/" + "x" * 50_000, "http://" + "." * 20_000 + "com/", "http://" + "b" * 100_000 + ".net/es/"]
    began = time.monotonic()
    _, got = judged(spark, urls, OP9_RULES)
    assert got == {i: brute(u, OP9_RULES) for i, u in enumerate(urls)}
    assert time.monotonic() - began < 60


def test_rules_that_are_incomplete_or_listed_twice(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "a.com", "/"), ("block", "a.com", "/"), (None, "b.com", "/"), ("block", None, "/x"), ("block", "b.com", None)], "action string, host string, path string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in UrlFilter(spark, rules, pages).judge(pages).collect()} == {1: ("a.com/", "block"), 2: ("b.com", "block")}


def test_levels_of_false_positives_are_sharded_too(spark):
    """Few listed keys, very many others: the second level alone is over the limit."""
    urls = [f"http://h{i}.com/" for i in range(20_000)]
    rules = [Rule("block", f"h{i}.com", "/") for i in range(0, 400, 4)]
    found, got = judged(spark, urls, rules, max_filter_bytes=130)
    assert found.shards > 1
    assert max(len(level.bits) for levels in found.cascades.values() for level in levels) <= 130
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}

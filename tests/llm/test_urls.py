from __future__ import annotations

import random
import re

import pytest

from renewlens.llm import urls

URLS = "page_id long, url string, html string, host string, path string, rule string, verdict string, blocked_url string, strict_hits int"


def pages(spark, *given):
    return spark.createDataFrame([(n, u, *[None] * 7) for n, u in enumerate(given)], URLS)


def slow(url, rules=urls.RULES, strict=urls.STRICT, soft=urls.SOFT):
    """The definition, term by term and rule by rule."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fitting = []
    for rule, verdict in rules:
        h, p = (rule + "\0").split("/", 1) if "/" in rule else (rule + "\0", "\0")
        h, p = h.strip("\0"), ("/" if "/" in rule else "") + p.strip("\0")
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fitting.append((len(rule), len(h), rule, verdict))
    seen = lambda t: re.search(rf"(?<![a-z0-9\x80-\U0010ffff]){re.escape(t)}(?![a-z0-9\x80-\U0010ffff])", low)
    hard, weak = [t for t in strict if seen(t)], [t for t in soft if seen(t)]
    rule, verdict = max(fitting)[2:] if fitting else (None, "block" if hard or len(weak) >= 2 else "allow")
    return host, path, rule, verdict, sorted(hard), sorted(weak)


def checked(found, given, **how):
    rows = found.collect()
    assert len(rows) == len(given)
    for r in rows:
        assert tuple(r)[1:] == slow(given[r["page_id"]], **how), given[r["page_id"]]


ODD = (
    None, "", "://", "no scheme casino", "http://", "http://Example.NET", "http://example.net/EN/", "http://example.net/en/a?b#c", "http://notexample.net/en/",
    "HTTP://WWW.CASINO.COM/x?y", "https://casinos.org/fr/", "https://mycasino.com/", "https://a.com/free/cheap", "https://a.com/free-free", "http://a.com?x=1#/p",
    "http://a.com#free/cheap?q", "http://a.com:80/de/", "http://x.example.com/de/q", "http://org/fr/", "http://.org/fr/", "http://a..org/fr/\nnew", "http://é.com/ébet/betting",
    "http://a.com/bet%20casino%2fx", "x://y://z.net/", "http://a.com/" + "free/" * 50_000, "http://" + "a." * 20_000 + "net/", "http://a.com/xxxcasinoxxx",
)


def test_odd_urls(spark):
    checked(urls.judge_urls(pages(spark, *ODD)), ODD)


def test_empty_table(spark):
    assert urls.judge_urls(pages(spark).repartition(2)).count() == 0 and urls.allowed(pages(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [urls.BROADCAST_RULES, 0])
def test_many_rules(spark, broadcast):
    draw = random.Random(5)
    domains = ["a", "b.a", "c.b.a", "bb.a", "d.c.b.a", "net"]
    rules = {f"{draw.choice(domains)}{draw.choice(['', '/', '/p', '/p/q', '/pq'])}": draw.choice(["allow", "block"]) for _ in range(40)}
    given = [f"http://{draw.choice(['', 'x.', 'y.x.', 'b'])}{draw.choice(domains)}{draw.choice(['', '/', '/p', '/p/q/r', '/pqr', '?p'])}" for _ in range(300)]
    given += [*ODD[:16], None]
    checked(urls.judge_urls(pages(spark, *given), list(rules.items()), broadcast_rules=broadcast), given, rules=list(rules.items()))


def test_rules_without_sense_are_left_out_and_strict_wins(spark):
    rules = spark.createDataFrame([("a", "allow"), ("a", "block"), (None, "allow"), ("b", None), ("b", "perhaps")], "rule string, verdict string")
    given = ["http://a/", "http://b/free"]
    found = {r["page_id"]: r for r in urls.judge_urls(pages(spark, *given), rules, ["FREE"], ["free", ""]).collect()}
    assert (found[0]["rule"], found[0]["verdict"]) == ("a", "block")
    assert (found[1]["rule"], found[1]["verdict"], found[1]["strict_hits"], found[1]["soft_hits"]) == (None, "block", ["free"], [])


def test_allowed_pages_keep_rows_and_columns(spark):
    given = [*ODD, *ODD]
    found = urls.allowed(pages(spark, *given))
    assert found.columns == pages(spark).columns
    assert sorted(r["page_id"] for r in found.collect()) == [n for n, u in enumerate(given) if slow(u)[3] == "allow"]

"""URL filters by a weighted vocabulary and host rules.

An Aho-Corasick automaton finds all terms of the vocabulary in one walk over a
lower-cased URL. A hit counts if it stands between boundaries. One strict term
rejects a page, soft terms only together: several distinct ones do. Rules for
hosts and paths come first: the longest that fits a URL decides whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, table

#: (rule, verdict): a host, and the start of a path behind it.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: One of these rejects a page.
STRICT = (
    "camgirl", "camgirls", "casino", "casinos", "cialis", "escorts", "hentai", "jackpot", "malware", "milf", "phishing", "porn", "porno",
    "pornhub", "roulette", "sexcam", "sportsbook", "viagra", "warez", "xxx",
)
#: Harmless alone; as many distinct ones as SOFT_LIMIT reject a page.
SOFT = (
    "ad", "ads", "adult", "babes", "bet", "bets", "betting", "bonus", "cam", "cams", "cheap", "click", "clicks", "coupon", "crack", "dating",
    "deal", "deals", "discount", "escort", "farm", "free", "gamble", "girls", "hot", "keygen", "loan", "loans", "lottery", "nude",
    "payday", "pharma", "pharmacy", "pill", "pills", "poker", "popup", "replica", "sex", "sexy", "slots", "spam", "torrent", "track",
    "tracker", "tracking", "win", "winner", "x",
)
SOFT_LIMIT = 2
#: Rules that may be sent to every task; more are joined to the distinct hosts and paths.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
#: What may stand beside a term: any ASCII character that is neither letter nor digit. Letters of other scripts are no boundary.
BOUNDARY = frozenset(chr(c) for c in range(128) if not chr(c).isalnum())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host behind the first ``://`` with A-Z lowered, and the path up to ``?``, ``#`` or the end; both empty if there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


@cache
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton over all terms; one per worker process."""
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(url: str, terms: tuple[str, ...]) -> set[str]:
    """The distinct terms that stand between boundaries in a lower-cased URL."""
    out = set()
    for end, term in automaton(terms).iter(url):
        start = end - len(term)
        if (start < 0 or url[start] in BOUNDARY) and (end + 1 == len(url) or url[end + 1] in BOUNDARY):
            out.add(term)
    return out


class Rules:
    """Rules by host. Of those that fit the longest text decides, then the longest host."""

    def __init__(self, rows: Iterable[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rows:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self.longest = max(map(len, self.by_host), default=0)

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule for the host or a domain above it."""
        best, at = (0, 0, None, None), len(host)
        while at > 0:  # domains from the last label on, none longer than any rule's host
            at = host.rfind(".", 0, at)
            if len(host) - at - 1 > self.longest:
                break
            domain = host[at + 1 :]
            for start, rule, verdict in self.by_host.get(domain, ()):
                if path.startswith(start) and (len(rule), len(domain)) > best[:2]:
                    best = len(rule), len(domain), rule, verdict
        return best[2:]


def _rule_table(spark, rules: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict), one row per rule; two verdicts for one rule become ``block``."""
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "rule string, verdict string")
    return (
        given.select("rule", "verdict").filter("rule IS NOT NULL AND verdict IN ('allow', 'block')")
        .groupBy("rule").agg(F.max("verdict").alias("verdict"))
    )


def _joined(picked: DataFrame, rules: DataFrame) -> DataFrame:
    """``picked`` with (rule, ruled) for any number of rules: they meet distinct hosts and paths, not pages."""
    cut = rules.select(
        F.substring_index("rule", "/", 1).alias("domain"), "rule", F.col("verdict").alias("ruled")
    ).withColumn("start", F.substr("rule", F.length("domain") + 1))
    longest = cut.agg(F.max(F.length("domain"))).first()[0] or 0
    places = picked.select("host", "path").distinct()
    # labels from the end; what is longer than any rule's host is not unfolded
    tail = F.when(F.length("host") > longest, F.substr("host", F.length("host") - F.lit(longest))).otherwise(F.concat(F.lit("."), "host"))
    labels = F.split(tail, r"\.")
    domains = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        places.select("host", "path", F.explode(F.when(F.size(labels) > 1, domains)).alias("domain"))
        .join(cut, "domain").filter(F.startswith("path", F.col("start")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), F.length("domain").alias("host_size"), "rule", "ruled")).alias("best"))
        .select("host", "path", "best.rule", "best.ruled")
    )
    return picked.join(found, ["host", "path"], "left")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Iterable[tuple[str, str]] = RULES,
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    url: str = "url",
    id_col: str = "page_id",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) per row of ``pages``.

    ``rules`` is a table or list of (rule, verdict ``allow`` or ``block``). A rule is a host and the start of a path; it fits
    its host and all subdomains if the path starts as it does. The longest rule that fits decides, with ``rule`` set;
    equally long ones by the longer host. Else one strict term or ``soft_limit`` distinct soft terms anywhere in the
    lower-cased URL block it. ``strict_hits`` and ``soft_hits`` list the distinct terms, sorted, ruled or not; a term that is in
    both vocabularies is strict. NULL, empty and odd URLs have no host, path or rule and are judged by their words; NULL is allowed. Rows stay rows,
    also repeated ones and those without an id. Very long URLs are read whole. An empty table gives an empty table. Other columns are not read.
    """
    spark = pages.sparkSession
    text = F.col(url).cast("string")
    host, path = host_and_path(text)
    picked = pages.select(
        F.col(id_col).alias("page_id"), text.alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )
    strict = tuple(sorted({t.translate(TO_LOWER) for t in strict if t}))
    soft = tuple(sorted({t.translate(TO_LOWER) for t in soft if t} - set(strict)))
    every, severe = strict + soft, frozenset(strict)
    wanted = _rule_table(spark, rules)
    head = wanted.limit(broadcast_rules + 1).collect()
    known = Rules((r["rule"], r["verdict"]) for r in head) if len(head) <= broadcast_rules else None
    if known is None:
        picked = _joined(picked, wanted).select("page_id", "url", "host", "path", "rule", "ruled")
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            if shared.value is None:
                ruled = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            else:
                ruled = (shared.value.decide(h, p) for h, p in zip(hosts, paths))
            out = [], [], [], []
            for one, (rule, verdict) in zip(urls, ruled):
                found = hits(one.translate(TO_LOWER), every) if one and every else set()
                hard, weak = sorted(found & severe), sorted(found - severe)
                worded = "block" if hard or len(weak) >= soft_limit else "allow"
                for column, value in zip(out, (rule, verdict or worded, hard, weak)):
                    column.append(value)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), batch.column(3), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                    pa.array(out[2], strings), pa.array(out[3], strings),
                ],
                ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    kind = picked.schema["page_id"].dataType.simpleString()
    return picked.mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>"
    )


def allowed(pages: DataFrame, url: str = "url", **how) -> DataFrame:
    """Rows of ``pages``, all columns, whose URL is allowed (see ``judge_urls``); repeated rows stay repeated.

    A verdict depends on the URL alone, so blocked URLs are found once each and their pages left out; those are few
    beside all pages, and a hot one is one row.
    """
    (key,) = free_names(pages.columns, "blocked_url")
    once = pages.select(F.col(url).cast("string").alias("url")).distinct().select("url", F.col("url").alias("page_id"))
    blocked = judge_urls(once, **how).filter("verdict = 'block'").select(F.col("page_id").alias(key))
    return pages.join(blocked, F.col(url).cast("string") == F.col(key), "left_anti")


def op11_urls(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all of ``pages``, with the numbers of distinct strict and soft terms."""
    found = judge_urls(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "host", "path", "rule", "verdict",
        F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft"),
    )


def _op11_sql() -> str:
    count = lambda terms: " + ".join(
        f"regexp_matches(low, '(^|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]){t}($|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])')::BIGINT" for t in terms
    )
    parts = [(rule, verdict, *rule.split("/", 1)) for rule, verdict in sorted(RULES, key=lambda r: len(r[0]), reverse=True)]
    fits = [
        (f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))", rule, verdict) for rule, verdict, h, p in parts
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parted AS (
  SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS given, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS behind FROM cut
), placed AS (
  SELECT page_id, low, translate(given, '{UPPER}', '{LOWER}') AS host, regexp_extract(behind, '^[^?#]*') AS path FROM parted
), judged AS (
  SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS ruled, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM placed
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM judged"""


OP11_SQL = _op11_sql()

"""URL filtering: rules by host and path prefix, and else a logistic regression on hashed character trigrams.

The scorer is a column expression: trigrams of `^host$` and `^path$` are hashed arithmetically into two halves of one weight
vector and the mean weight decides. The vector comes from a small labelled table (at most MAX_LABELLED rows; more are
refused), fitted on the driver by full-batch gradient descent; its weights are rounded to integers, so that sums are exact
in any engine. Null urls, and urls without `://`, have an empty host and path, fit no rule and are judged by the bias.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import let

HALF = 2048
MAX_LABELLED = 5000
MAX_RULES = 1000
SCALE = 10_000

#: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_BAD_HOSTS = ("casino-bonus", "free-pills", "adult-cams", "win-prize", "cheap-meds", "click-track", "ads-server", "poker-slots", "crypto-double", "hot-dates")
_BAD_PATHS = ("/click?id=1", "/win/jackpot", "/promo/free-bonus", "/out/redirect", "/xxx/cam", "/buy/cheap-pills", "/track/pixel", "/login/cart")
_GOOD_HOSTS = ("www.example", "blog.example", "m.example", "news.example", "library.example", "docs.example", "journal.example", "wiki.example", "school.example", "thread.example")
_GOOD_PATHS = ("/en/12", "/fr/825", "/de/31", "/es/404", "/article/2020", "/wiki/topic", "/docs/guide", "/en/archive/7")
_ENDS = ("com", "net", "org")


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table, (url, 1 to block): invented hosts and paths, crossed."""
    bad = [(f"http://{h}.{_ENDS[(i + j) % 3]}{p}", 1) for i, h in enumerate(_BAD_HOSTS) for j, p in enumerate(_BAD_PATHS)]
    good = [(f"https://{h}.{_ENDS[(i + j) % 3]}{p}", 0) for i, h in enumerate(_GOOD_HOSTS) for j, p in enumerate(_GOOD_PATHS)]
    return bad + good


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, parts, 2)


def split_url(url: str) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[:end]


def _slots(host: str, path: str) -> list[int]:
    out = []
    for half, text in enumerate((host, path)):
        codes = [ord(c) for c in f"^{text}$"]
        out += [half * HALF + (a * 961 + b * 31 + c) % HALF for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]
    return out


def train(labelled: Sequence[tuple[str, int]] | None = None, steps: int = 300, rate: float = 20.0, ridge: float = 1e-4) -> tuple[list[int], int]:
    """(weights, bias) as integers of 1 / SCALE, from (url, 1 to block) rows; two-class, full batch, deterministic."""
    rows = labelled_urls() if labelled is None else list(labelled)
    if not 0 < len(rows) <= MAX_LABELLED:
        raise ValueError(f"between 1 and {MAX_LABELLED} labelled urls are expected, not {len(rows)}")
    data = [(s, len(s) or 1, y) for s, y in ((_slots(*split_url(u)), y) for u, y in rows)]
    w, bias = [0.0] * (2 * HALF), 0.0
    for _ in range(steps):
        grad, grad_bias = {}, 0.0
        for slots, n, y in data:
            z = bias + sum(w[s] for s in slots) / n
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            grad_bias += miss
            for s in slots:
                grad[s] = grad.get(s, 0.0) + miss / n
        bias -= rate / 10 * grad_bias / len(data)
        for s, g in grad.items():
            w[s] -= rate * (g / len(data) + ridge * w[s])
    return [round(x * SCALE) for x in w], round(bias * SCALE)


def logit(host: Column, path: Column, weights: Sequence[int], bias: int) -> Column:
    """The logit times SCALE times the number of trigrams, a long: positive means block."""
    literal = F.expr("array(" + ",".join(f"{w}L" for w in weights) + ")")  # folded to one constant by the optimizer

    def total(text: Column, half: int) -> Column:
        def over(codes: Column) -> Column:
            last = F.size(codes) - 3
            inside = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            slot = lambda i: half * HALF + F.pmod(F.get(codes, i) * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2), F.lit(HALF))
            return F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, i: s + F.get(literal, slot(i).cast("int")))

        return let(F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("bigint")), over)

    return F.lit(bias).cast("bigint") * F.greatest(F.length(host) + F.length(path), F.lit(1)) + total(host, 0) + total(path, 1)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """pages: url and any other columns. Adds host, path, rule (host and path of the longest that fits, then of the longest
    host; null if none does), block_score (the logit times the trigrams, as an integer) and verdict (allow or block)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are expected, not {len(rules)}")
    host, path = host_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    weights, bias = train(labelled)
    out = out.withColumns({"rule": rule, "block_score": logit(F.col("host"), F.col("path"), weights, bias)})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") > 0, "block").otherwise("allow")))


def sql(rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> str:
    """The same for DuckDB, over the view pages."""
    weights, bias = train(labelled)
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in ordered) + " ELSE CASE WHEN z > 0 THEN 'block' ELSE 'allow' END END"
    slots = lambda c, half: f"list_transform(range(0, greatest(len({c}) - 2, 0)), lambda i: {half * HALF} + ({c}[i + 1] * 961 + {c}[i + 2] * 31 + {c}[i + 3]) % {HALF})"
    return rf"""
WITH m AS (SELECT CAST({list(weights)} AS BIGINT[]) AS w),
v AS (SELECT unnest(w) AS weight, generate_subscripts(w, 1) - 1 AS slot FROM m),
p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), c AS (
  SELECT rid, list_transform(string_split('^' || host || '$', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS hc,
    list_transform(string_split('^' || path || '$', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS pc FROM p
), g AS (SELECT rid, unnest(list_concat({slots('hc', 0)}, {slots('pc', 1)})) AS slot FROM c),
t AS (SELECT rid, sum(weight) AS total FROM g JOIN v ON v.slot = g.slot GROUP BY rid),
s AS (SELECT p.*, {bias} * greatest(length(host) + length(path), 1) + coalesce(t.total, 0) AS z FROM p LEFT JOIN t ON t.rid = p.rid)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM s
"""

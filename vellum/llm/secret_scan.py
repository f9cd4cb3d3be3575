"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests finds to be keys.

All of it is column expressions. Matches get their positions from the lengths of the pieces between them. A candidate token
has an encoding inferred from its alphabet (hex, base32, base36 or base64); a chi-squared test of uniformity over that
alphabet (normal by Wilson and Hilferty), a runs test about the alphabet's middle and a lag-1 serial correlation are
combined into one statistic that random strings pass. Against the null hypothesis of an ordinary token (a Markov chain
over character classes) the likelihood ratio of the uniform model bounds a p-value, 2 to the minus its bits, which falls
with length; Benjamini and Hochberg's procedure over a text's candidates then controls false discoveries.

Null texts count as empty and give no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import let

#: Fixed patterns and the order of their kinds. The first has the value in group 1.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery. Ordinary long words have no digit and are no candidates.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The combined statistic of the battery is chi-squared with 3 degrees of freedom for random strings; this is its 0.999 quantile.
BATTERY = 16.27
#: Share of false discoveries allowed among a text's findings.
FALSE_SHARE = 1e-4
#: Matches of a text that are placed together.
BLOCK = 256
STAY, LEAVE = math.log2(0.9), math.log2(0.1 / 3)

SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string,token:string>"


def _in_blocks(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))))


def _spans(text: Column, pattern: str, kind: str, least: int, group: int = 0, gate: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters or more. Positions are running sums of
    lengths, taken over blocks first and then within each, since appending to one array costs its length every time."""
    order = KINDS.index(kind)
    none = F.array().cast(f"array<{SPAN}>")
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.regexp_extract_all(text, F.lit(pattern), group).alias("g"), F.split(text, pattern, -1).alias("before"))
    width = lambda x: (F.length(x["before"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("bigint")

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + width(x)
        span = F.struct((s["at"] + F.length(x["before"])).cast("bigint").alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["g"].alias("token"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        totals = F.transform(blocks, lambda own: F.aggregate(own, zero, lambda s, x: s + width(x)))
        starts = F.aggregate(F.slice(totals, F.lit(1), F.size(totals) - 1), F.array(zero), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
        return F.flatten(F.zip_with(blocks, starts, lambda own, at: F.aggregate(own, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])))

    return F.when(text.rlike(pattern) if gate is None else gate, let(let(found, _in_blocks), placed)).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others, which are looked up by blocks of them."""
    meets = lambda x, b: (b["start"] < x["end"]) & (x["start"] < b["end"])

    def free(blocks: Column) -> Column:
        bounds = F.transform(blocks, lambda own: F.struct(F.get(own, 0)["start"].alias("start"), F.array_max(F.transform(own, lambda b: b["end"])).alias("end"), own.alias("own")))
        return let(bounds, lambda bounds: F.filter(spans, lambda x: ~F.exists(bounds, lambda k: meets(x, k) & F.exists(k["own"], lambda b: meets(x, b)))))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(_in_blocks(F.array_sort(others)), free)).otherwise(spans)


def _random_bits(token: Column) -> Column:
    """Bits of evidence that a token is random and not ordinary, or 0 if the battery rejects randomness."""
    code = lambda c: F.ascii(c)
    cls = lambda c: F.when(code(c).between(48, 57), 0).when(code(c).between(97, 122), 1).when(code(c).between(65, 90), 2).otherwise(3)
    bits_in = lambda c: F.when(cls(c) == 0, math.log2(10)).when(cls(c) == 3, 2.0).otherwise(math.log2(26))
    kind = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(token.rlike("^[A-Z2-7]+=*$"), 32)
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36)
        .otherwise(64)
    )

    def tested(t: Column) -> Column:
        """t: kind (size of the alphabet), chars, classes, values (places in the alphabet, digits first), mean."""
        n, size, values, classes = F.size(t["chars"]), t["kind"], t["values"], t["classes"]
        pairs = F.sequence(F.lit(0), n - 2)
        squares = F.aggregate(F.array_distinct(t["chars"]), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(t["chars"], lambda x: x == c)).cast("double"), F.lit(2)))
        df = (size - 1).cast("double")
        z_chi = (F.pow(F.greatest(size * squares / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n_high = F.size(F.filter(values, lambda x: x >= size / 2)).cast("double")
        turns = F.aggregate(pairs, F.lit(1), lambda s, i: s + ((F.get(values, i) >= size / 2) != (F.get(values, i + 1) >= size / 2)).cast("int"))
        runs_mean = 1 + 2 * n_high * (n - n_high) / n
        runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
        z_runs = F.when(runs_var > 0, (turns - runs_mean) / F.sqrt(runs_var)).otherwise(6.0)
        spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - t["mean"]) * (x - t["mean"]))
        along = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + (F.get(values, i) - t["mean"]) * (F.get(values, i + 1) - t["mean"]))
        z_serial = F.when(spread > 0, along / spread * F.sqrt(n.cast("double"))).otherwise(6.0)
        battery = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2)) + z_runs * z_runs + z_serial * z_serial
        ordinary = F.aggregate(t["chars"], F.lit(0.0), lambda s, c: s - bits_in(c)) + F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.when(F.get(classes, i) == F.get(classes, i + 1), STAY).otherwise(LEAVE))
        bits = -n * F.log2(size.cast("double")) - ordinary
        return F.when(battery <= BATTERY, F.greatest(bits, F.lit(0.0))).otherwise(0.0)

    def place(c: Column, size: Column) -> Column:
        return F.when(code(c).between(48, 57), code(c) - 48).when(code(c).between(97, 122), code(c) - 87).when(code(c).between(65, 90), F.when(size == 64, code(c) - 29).otherwise(code(c) - 55)).when(c.isin("+", "-"), 62).otherwise(63)

    read = F.struct(kind.alias("kind"), F.split(token, "").alias("chars"))
    valued = lambda t: F.struct(t["kind"].alias("kind"), t["chars"].alias("chars"), F.transform(t["chars"], cls).alias("classes"), F.transform(t["chars"], lambda c: place(c, t["kind"]).cast("double")).alias("values"))
    meant = lambda t: F.struct(t["kind"].alias("kind"), t["chars"].alias("chars"), t["classes"].alias("classes"), t["values"].alias("values"), (F.aggregate(t["values"], F.lit(0.0), lambda s, x: s + x) / F.size(t["values"])).alias("mean"))
    return let(read, lambda a: let(valued(a), lambda b: let(meant(b), tested)))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs: a text and any other columns. Adds secret_spans (in place of any column so called), an array of
    (start, ord, end, kind, token), by start and kind."""
    own = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(
        "__vellum_base",
        F.concat(
            _spans(own, ASSIGN, "assign", 8, 1),
            _spans(own, ACCESS, "access", 16, gate=own.rlike("AKIA[A-Z0-9]{12}")),
            _spans(own, r"[0-9a-f]{32,}", "hex", 32),
        ),
    )
    ordinary = lambda token: ~(token.rlike("[0-9]") & token.rlike("[A-Za-z]"))
    any_likely = own.rlike(CANDIDATE) & F.exists(F.regexp_extract_all(own, F.lit(CANDIDATE), 0), lambda run: ~ordinary(run))
    out = out.withColumn("__vellum_likely", F.filter(_spans(own, CANDIDATE, "random", 20, gate=any_likely), lambda x: ~ordinary(x["token"])))
    likely = _apart(F.col("__vellum_likely"), F.col("__vellum_base"))
    out = out.withColumn("__vellum_likely", likely)
    scored = F.when(F.size("__vellum_likely") > 0, F.transform("__vellum_likely", lambda x: F.struct((-_random_bits(x["token"])).alias("less"), x.alias("span")))).otherwise(F.array().cast(f"array<struct<less:double,span:{SPAN}>>"))
    out = out.withColumn("__vellum_scored", F.array_sort(scored))
    needed = lambda i: F.log2((F.size("__vellum_scored") / (FALSE_SHARE * i)).cast("double"))
    ranks = F.when(F.size("__vellum_scored") > 0, F.sequence(F.lit(1), F.size("__vellum_scored"))).otherwise(F.array().cast("array<int>"))
    found = F.coalesce(F.array_max(F.filter(ranks, lambda i: -F.get(F.col("__vellum_scored"), i - 1)["less"] >= needed(i))), F.lit(0))
    added = F.transform(F.slice("__vellum_scored", F.lit(1), found), lambda x: x["span"])
    return out.withColumn("secret_spans", F.array_sort(F.concat("__vellum_base", added))).drop("__vellum_base", "__vellum_likely", "__vellum_scored")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs in which no secret is found; all columns stay."""
    held = docs.withColumnRenamed("secret_spans", "__vellum_held")
    return scan_secrets(held).where(F.size("secret_spans") == 0).drop("secret_spans").withColumnRenamed("__vellum_held", "secret_spans")

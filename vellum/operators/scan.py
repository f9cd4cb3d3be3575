"""Zones in plain text: candidate lines, their runs and tails, joined rows, compatible formats and the best parse.

Per document, everything up to the candidates is array expressions on the row; only candidates are exploded, and the best
parse is one window over a document's few candidate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import charset as C
from vellum.functions.checksum import let
from vellum.operators import zones as Z

TOLERANCE = 6
#: More than any format's width and any line of two rows: a longer line has the same candidates, none, when cut to it.
_WIDE = 90
#: Where a text breaks into lines.
BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def text_lines(text: Column) -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != "")


def _rows(lines: Column) -> Column:
    """Lines normalised, each with whether it is like a zone's."""
    own = lambda line, x: F.struct(line.alias("line"), ((F.length(line) >= 24) & (C.zone_ratio(x) >= 0.6)).alias("ok"))
    plain = lambda x: x.rlike(r"\A[A-Z0-9<]+\z")  # noqa: E731 - such a line is its own normalised one, and all of its alphabet
    return F.transform(lines, lambda x: F.when(plain(x), F.struct(x.alias("line"), (F.length(x) >= 24).alias("ok"))).otherwise(let(C.normalize_line(x), lambda line: own(line, x))))


def _tails(rows: Column) -> Column:
    """The last three and two of each run."""
    ok = lambda i: F.coalesce(F.get(rows, i)["ok"], F.lit(False))
    places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(places, lambda i: ok(i) & ~ok(i + 1))
    tail = lambda i, n: F.transform(F.slice(rows, i - n + 2, F.lit(n)), lambda r: r["line"])
    none = F.array().cast("array<array<string>>")
    both = lambda i: F.concat(F.when((i >= 2) & ok(i - 1) & ok(i - 2), F.array(tail(F.greatest(i, F.lit(2)), 3))).otherwise(none), F.when((i >= 1) & ok(i - 1), F.array(tail(F.greatest(i, F.lit(1)), 2))).otherwise(none))
    return F.flatten(F.transform(ends, both))


def _joined(rows: Column) -> Column:
    """Lines that hold two rows, cut in two."""
    n = lambda r: F.length(r["line"])
    halves = lambda r, w: F.array(F.substring(r["line"], 1, w), F.substring(r["line"], F.lit(w + 1), n(r)))
    joined = F.transform(rows, lambda r: F.when(n(r).between(87, 89), halves(r, 44)).when(n(r).between(71, 73), halves(r, 36)))
    return F.filter(joined, lambda j: j.isNotNull())


def candidate_groups(lines: Column) -> Column:
    """lines: array of non-blank raw lines. Candidates as arrays of normalised lines, in the order in which they are tried:
    the last three and two of each run of zone-like lines, then lines that hold two rows."""
    return let(_rows(lines), lambda rows: F.concat(_tails(rows), _joined(rows)))


def head(text: Column) -> Column:
    """What a text that many pages begin with leaves for their scans, so that it is read once: its own candidates that have a
    format, and the last three lines of a run that what follows may continue, as far as their width counts."""

    def found(rows: Column) -> Column:
        ended = F.coalesce(F.array_max(F.transform(rows, lambda r, i: F.when(~r["ok"], i + 1))), F.lit(0))  # rows to the last that ends a run
        fit = lambda groups: F.filter(groups, lambda g: F.size(formats_for(g)) > 0)
        last = F.slice(rows, F.greatest(ended, F.size(rows) - 3) + 1, F.lit(3))
        short = lambda r: F.struct(F.substring(r["line"], 1, _WIDE).alias("line"), r["ok"].alias("ok"))
        return F.struct(fit(let(F.slice(rows, F.lit(1), ended), _tails)).alias("tails"), F.transform(last, short).alias("open"), fit(_joined(rows)).alias("joined"))

    return let(_rows(text_lines(text)), found)


def formats_for(lines: Column) -> Column:
    """(fmt_no, mrz_type) of the formats whose rows, width and kind of document agree with the lines."""
    width, first = F.array_max(F.transform(lines, F.length)), F.substring(F.get(lines, 0), 1, 1)
    visa = F.when(first.rlike("^[A-Z]$"), first == "V")
    fits = []
    for k, name in enumerate(Z.FORMAT_ORDER):
        rows, expected = Z.SHAPES[name]
        ok = (F.size(lines) == rows) & (F.abs(width - expected) <= TOLERANCE) & F.coalesce(visa == F.lit(name.startswith("MRV")), F.lit(True))
        fits.append(F.when(ok, F.struct(F.lit(k).alias("fmt_no"), F.lit(name).alias("mrz_type"))))
    return F.filter(F.array(*fits), lambda x: x.isNotNull())


def parse_candidates(candidates: DataFrame, *keys: str) -> DataFrame:
    """candidates: keys, cand_no, lines, ocr_confidence. The best parse of each key: the highest rank, then the first
    candidate, then the first format."""
    tried = candidates.withColumn("_f", F.explode(formats_for(F.col("lines")))).select(*keys, "ocr_confidence", "cand_no", "lines", "_f.*")
    lines = F.filter("lines", lambda x: x != "")
    tried = tried.where(F.size(lines) >= F.when(F.col("mrz_type") == "TD1", 3).otherwise(2)).withColumns({f"line{i + 1}": F.get(lines, i) for i in range(3)})
    parsed = Z.decode(tried.drop("lines")).withColumn("rank", Z.rank_score())
    best = Window.partitionBy(*keys).orderBy(F.desc("rank"), "cand_no", "fmt_no")
    return parsed.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


def scan_text(pages: DataFrame, *keys: str) -> DataFrame:
    """pages: keys, text, ocr_confidence. The best parse of each text that has a candidate (it may be structurally invalid;
    documents.strict() leaves such out); other texts give no row."""
    found = pages.withColumn("_lines", text_lines(F.col("text"))).select(*keys, "ocr_confidence", F.posexplode(candidate_groups(F.col("_lines"))).alias("cand_no", "lines"))
    return parse_candidates(found, *keys)


def scan_after(pages: DataFrame, *keys: str) -> DataFrame:
    """scan_text() of pages whose texts begin with a text that is known by its head(): keys, head (null: none), text (the lines
    after it), ocr_confidence."""
    of = lambda name, kind: F.coalesce(F.col("head")[name], F.array().cast(kind))
    groups = "array<array<string>>"
    run = of("open", "array<struct<line:string,ok:boolean>>")
    every = let(_rows(text_lines(F.col("text"))), lambda rows: F.concat(of("tails", groups), let(F.concat(run, rows), _tails), of("joined", groups), _joined(rows)))
    return parse_candidates(pages.select(*keys, "ocr_confidence", F.posexplode(every).alias("cand_no", "lines")), *keys)

import datetime
import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import dates as Dt
from vellum.functions import languages as G
from vellum.operators import documents as D
from vellum.operators import passes as P
from vellum.operators import redact as X
from vellum.operators import regions as B
from vellum.operators import scan as S
from vellum.operators import zones as Z
from vellum.plans import readings
from vellum.sources import providers, store

REF = datetime.date(2026, 9, 1)
STRIP = "doc_id long, box_no long, x int, y int, width int, height int, image_width int, image_height int"
TD3 = ("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10")


def documents(spark, *zones):
    rows = [(i, "TD3", a, b, None, 0.94) for i, (a, b) in enumerate(zones)]
    decoded = Z.decode(spark.createDataFrame(rows, "doc_id long, mrz_type string, line1 string, line2 string, line3 string, ocr_confidence double"))
    return D.with_document(decoded, F.lit(REF))


def test_accessors(spark):
    merged = (TD3[0].replace("<<ANNA", "<ANNA"), TD3[1])
    got = D.accessors(documents(spark, TD3, merged, ("P<D<<X", "1" * 44))).orderBy("doc_id").collect()
    assert got[0].full_name == "ANNA MARIA ERIKSSON" and got[0].verified == ["document_number", "birth_date", "expiry_date", "optional_data", "personal_number"]
    assert got[0].present == list(D.FIELDS) and got[0].summary == "TD3 valid=True confidence=0.99 fields=12/12 verified=5"
    assert got[1].full_name == "ERIKSSON ANNA MARIA" and "given_names" not in got[1].present
    assert "valid=False" in got[2].summary and len(got[2].errors) == len(set(got[2].errors))
    flat = D.flat(documents(spark, TD3), "doc_id").first()
    assert flat.document_number == "L898902C3" and flat.birth_date == "1974-08-12"


def test_better_of_two_readings(spark):
    merged = (TD3[0].replace("<<ANNA", "<ANNA"), TD3[1])
    first, second = documents(spark, TD3, merged, TD3), documents(spark, merged, TD3, merged, TD3).where("doc_id <> 2")
    got = {x.doc_id: x.n for x in D.better(first, second, "doc_id").select("doc_id", D.full_name().alias("n")).collect()}
    assert got == dict.fromkeys(range(4), "ANNA MARIA ERIKSSON")


def test_reread_and_countries(spark):
    rows = [(["a", "b"], ["a"], None, True), (["a"], ["a"], True, False), (["a"], [], False, False), (["a"], [], True, True)]
    df = spark.createDataFrame(rows, "w array<string>, f array<string>, i boolean, e boolean")
    assert all(x.e == x.got for x in df.withColumn("got", D.reread_eligible(F.col("w"), F.col("f"), F.col("i"))).collect())
    codes = spark.createDataFrame([("UTO",), ("D<<",), ("U1O",), ("UT",), (None,)], "c string")
    assert [x[0] for x in codes.select(D.plausible_country(F.col("c"))).collect()] == [True, True, False, False, False]


def test_bands(spark):
    rows = [(1, 1, 20, 600, 900, 20), (1, 2, 30, 630, 880, 20), (1, 3, 40, 100, 700, 30), (1, 4, 0, 0, 100, 30), (2, 1, 0, 0, 10, 10)]
    got = B.zone_bands(spark.createDataFrame([(*r, 1000, 700) for r in rows], STRIP), "doc_id").orderBy("doc_id", "rank").collect()
    assert [(x.doc_id, x.rank, x.x, x.y, x.width, x.height, x.source) for x in got] == [(1, 0, 2, 583, 936, 84, "morphology"), (1, 1, 26, 90, 728, 50, "morphology"), (1, 2, 0, 504, 1000, 196, "fallback"), (2, 0, 0, 504, 1000, 196, "fallback")]


def test_skew_and_corners(spark):
    angles = spark.createDataFrame([(1, a) for a in (1.0, 2.0, 3.0, 40.0)] + [(2, 1.0), (2, 2.0)] + [(3, 0.1)] * 5, "doc_id long, angle double")
    assert {x.doc_id: x.skew for x in B.skew(angles, "doc_id").collect()} == {1: 2.0, 2: 0.0, 3: 0.0}
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((90, 80), (10, 5), (8, 70), (95, 12))))
    assert [tuple(p) for p in spark.range(1).select(B.order_corners(points)).first()[0]] == [(10, 5), (95, 12), (90, 80), (8, 70)]


def test_passes(spark):
    turns = spark.createDataFrame([(1, 0, "readable enough text here", 0.9), (1, 1, "more " * 30, 0.9), (2, 0, "x", 0.9), (2, 1, "abc", 0.9), (2, 2, "abd", 0.9), (3, 2, None, None)], "doc_id long, turns int, text string, confidence double")
    assert {x.doc_id: x.turns for x in P.best_orientation(turns, "doc_id").collect()} == {1: 0, 2: 1, 3: 2}
    tries = spark.createDataFrame([(1, 0, 0, True, False), (1, 0, 1, True, True), (1, 1, 0, False, False), (1, 1, 1, True, True), (2, 0, 0, True, False)], "doc_id long, region int, attempt int, has_text boolean, parsed boolean")
    assert [tuple(x) for x in P.first_match(tries, "doc_id").collect()] == [(1, 1, 1)]
    boxes = spark.createDataFrame([(1, "a", 0.2), (1, " ", 0.9), (1, "b", 0.4), (2, None, 0.9)], "doc_id long, text string, confidence double")
    assert {x.doc_id: round(x.mean_confidence, 6) for x in P.block_mean(boxes, "doc_id").collect()} == {1: 0.3, 2: 0.0}
    assert {x.doc_id: x.warning for x in P.confident(boxes, 0.3, "doc_id").collect()} == {1: "1 block(s) dropped below min_confidence", 2: None}


def test_scores_in_fixed_order(spark, tmp_path):
    assert (0.1 + 0.2) + 0.3 > 0.6 == (0.3 + 0.2) + 0.1
    rows = [(1, 2, "aa", 0.3, 0), (1, 3, "a", 0.3, 3), (1, 3, "a", 0.2, 2), (1, 3, "a", 0.1, 1), (1, 3, None, None, 4), (2, 1, "a", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, turns int, text string, confidence double, place int")
    for n in (1, 4):
        best = lambda d: {x.doc_id: (x.turns, x.score) for x in P.best_orientation(d.repartition(n), "doc_id", order="place").collect()}  # noqa: B023, E731
        assert best(df) == {1: (3, 0.1 + 0.2 + 0.3), 2: (1, 0.0)}
        assert best(df.withColumn("place", -F.col("place"))) == {1: (2, 0.6), 2: (1, 0.0)}
    # the same out of a table, in the order of its rows
    line = lambda *ds: spark.createDataFrame([(1, 2 if i else 3, 1.0 + i, d) for i, d in ds], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").coalesce(1)
    path = tmp_path / "lineitem.parquet"
    line((1, 0.24), (0, 0.1), (0, 0.2), (0, 0.3)).write.parquet(str(path))
    assert [(x.doc_id, x.turns, x.score) for x in readings.page_turns(spark, str(tmp_path)).collect()] == [(1, 3, 1.2)]


def test_languages(spark):
    rows = [("x", "en"), ("en:a,ar:b", "ara"), ("de: ", "german"), ("fr:z", "en"), ("", "en"), (None, "en")]
    df = spark.createDataFrame(rows, "v string, l string")
    assert [x[0] for x in df.select(G.model_override(F.col("v"), F.col("l"))).collect()] == ["x", "b", None, None, None, None]
    assert G.parse_list('["a", "b"]') == G.parse_list(" a, b ,") == ["a", "b"] and G.parse_list("[a, b") == ["a", "b"] and G.parse_list(["c"]) == ["c"]


class Broken(providers.Scripted):
    def recognise(self, image, lang):
        if lang == "fr":
            raise ValueError("no model")
        return super().recognise(image, lang)


def test_recognise_and_registry(spark):
    boxes = {"en": [{"text": "a", "confidence": 0.5, "polygon": [{"x": 1.0, "y": 2.0}]}]}
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "doc_id long, content binary")
    got = providers.recognise(images, lambda: Broken(boxes), ["en", "fr"]).orderBy("doc_id", "pass_no").collect()
    assert [(x.doc_id, x.lang, len(x.blocks), x.error) for x in got] == [(1, "en", 1, None), (1, "fr", 0, "no model"), (2, "en", 1, None), (2, "fr", 0, "no model")]
    assert got[0].blocks[0].lang == "en" and providers.providers.create(" STUB ").name == "stub" and providers.parsers.create("ICAO") is S
    with pytest.raises(ValueError, match="unknown parser"):
        providers.parsers.create("x")


def test_store_and_log(spark, tmp_path):
    files = spark.createDataFrame([("image/png", "2026-01-02 23:00:00"), (None, "2026-01-03 01:00:00")], "mime string, at string")
    at = F.col("at").cast("timestamp")
    store.write(files, str(tmp_path / "no"), at)
    assert not (tmp_path / "no").exists()
    store.write(files, str(tmp_path / "yes"), at, enabled=True)
    assert sorted(p.name for p in (tmp_path / "yes").iterdir() if p.is_dir()) == ["day=2026-01-02", "day=2026-01-03"]
    assert sorted(x.ref[32:] for x in spark.read.parquet(str(tmp_path / "yes")).collect()) == [".bin", ".png"]
    records = spark.createDataFrame([("m " + "A" * 30, {"DOB": "x", "n": None}, "r1"), ("plain", None, None)], "message string, extras map<string,string>, request_id string")
    lines = [json.loads(x.json) for x in store.log_lines(records.withColumns({"at": F.lit("2026-01-02 03:04:05").cast("timestamp"), "level": F.lit("INFO"), "logger": F.lit("l")}), "s", "1", "test").collect()]
    assert lines[0]["message"] == "m [REDACTED]" and lines[0]["DOB"] == "[REDACTED]" and lines[0]["n"] is None and lines[0]["request_id"] == "r1"
    assert "request_id" not in lines[1] and lines[1]["timestamp"].startswith("2026-01-02T03:04:05")


def test_scrub_depth():
    deep = last = {}
    for _ in range(9):
        last["k"] = {}
        last = last["k"]
    assert json.dumps(X.scrub(deep)) == '{"k": ' * 7 + '"[REDACTED]"' + "}" * 7


def test_dates_in_text(spark):
    rows = [
        ("born 12 JAN 2001.", "2001-01-12"), ("12-MAR-99", "1999-03-12"), ("12 MARCH 1999 or 3.4.1998", "1998-04-03"), ("1999-05-06", "1999-05-06"), ("12345/06/2001", None), ("on 1 2 3 4 5 2001", "1903-02-01"),
        ("99 1 2 2003", "0099-01-02"), ("x31122001y", "2001-12-31"), ("311220011", None), ("٣١/١٢/٢٠٠١", "2001-12-31"), ("12 مارس 2001", "2001-03-12"), ("no", None), (None, None), ("5/6", None), ("45/13/2001 then 01/02/2003", "2003-02-01"),
    ]
    df = spark.createDataFrame(rows, "t string, e string")
    got = df.select("t", "e", F.date_format(Dt.parse_free_date(F.col("t"), "birth", F.lit(REF)), "yyyy-MM-dd").alias("got")).collect()
    assert [(x.t, x.got) for x in got] == [(t, e) for t, e in rows]

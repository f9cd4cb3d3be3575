import datetime
import random

import duckdb
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import labels as V
from vellum.operators import layout as L
from vellum.operators import ratelimit as R
from vellum.operators import redact as X
from vellum.plans import pages, sql
from vellum.sources import recognised, uploads
from vellum.streaming import ratelimit as SR

DIR = "/root/testdata/sf0.001"
BLOCKS = "doc_id long, block_no int, text string, confidence double, polygon array<struct<x:double,y:double>>, lang string"


def box(doc, no, text, x=40, y=40, w=200, h=24, confidence=0.95, lang="en"):
    return (doc, no, text, confidence, [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))], lang)


def lines(spark, *boxes):
    return L.group_lines(spark.createDataFrame(list(boxes), BLOCKS), "doc_id").orderBy("doc_id", "reading_order").collect()


def test_lines(spark):
    assert [x.text for x in lines(spark, box(1, 1, "a", y=40), box(1, 2, "b", x=300, y=42), box(2, 1, "a", y=40), box(2, 2, "b", y=120))] == ["a b", "a", "b"]
    assert lines(spark, box(1, 1, "محمد", x=300), box(1, 2, "احمد", x=400))[0].text == "احمد محمد"
    one = lines(spark, box(1, 1, "a", confidence=0.1), box(1, 2, "b" * 20, x=300, confidence=1.0))[0]
    assert one.confidence > 0.9 and one.min_confidence == 0.1
    plain = [(1, 1, "x", 0.5, [], "en"), (1, 2, "y", 0.5, None, "ar"), (1, 3, " ", 0.5, None, "ar")]
    assert [x.text for x in lines(spark, *plain)] == ["x", "y"]
    assert [x.text for x in lines(spark, *plain, box(1, 4, "z"))] == ["z"]


def test_sums_in_fixed_order(spark):
    # boxes join the line from the top; summed from the left, its confidence would end in another digit
    boxes = [box(1, 3, "small plate", x=400, y=108, w=63, h=18, confidence=0.9), box(1, 4, "blue anvil", x=440, y=108, w=81, h=19, confidence=0.58), box(1, 5, "small gizmo", x=0, y=108, w=99, h=21, confidence=0.86)]
    line = lines(spark, *boxes)[0]
    assert line.blocks == [5, 3, 4] and line.confidence == (0.9 * 11 + 0.58 * 10 + 0.86 * 11) / 32 != (0.86 * 11 + 0.9 * 11 + 0.58 * 10) / 32
    sure = [0.1, 0.2, 0.3, 0.7]
    rows = spark.createDataFrame([(1, 3 - i, "a", c) for i, c in enumerate(reversed(sure))] + [(1, 9, "a", None), (2, 0, "a", None)], "doc_id long, reading_order int, text string, confidence double")
    for n in (1, 3):
        assert {x.doc_id: x.mean for x in L.page_summary(rows.repartition(n), "doc_id", order="reading_order").collect()} == {1: (((0.1 + 0.2) + 0.3) + 0.7) / 4, 2: None}


def brute_lines(boxes):
    groups = []
    for b in sorted(boxes, key=lambda b: (b["cy"], b["x0"], b["no"])):
        for g in groups:
            if abs(b["cy"] - sum(o["cy"] for o in g) / len(g)) <= 0.6 * max(max(o["h"] for o in g), b["h"], 1):
                g.append(b)
                break
        else:
            groups.append([b])
    groups.sort(key=lambda g: (min(o["y0"] for o in g), min(o["x0"] for o in g)))
    return [[o["no"] for o in sorted(g, key=lambda o: o["x0"])] for g in groups]


def test_lines_and_suppression_equal_brute_force(spark):
    r = random.Random(1)
    rows = [box(d, n, "w", x=r.randrange(500), y=r.randrange(200), w=r.randrange(20, 200), h=r.randrange(8, 40), confidence=r.randrange(100) / 100) for d in range(20) for n in range(25)]
    got = {}
    for x in lines(spark, *rows):
        got.setdefault(x.doc_id, []).append(x.blocks)
    kept = {}
    for x in L.suppress(spark.createDataFrame(rows, BLOCKS), "doc_id", threshold=0.3).orderBy("doc_id", "rank").collect():
        kept.setdefault(x.doc_id, []).append(x.block_no)
    for d in range(20):
        own = [{"no": b[1], "x0": b[4][0][0], "y0": b[4][0][1], "x1": b[4][2][0], "y1": b[4][2][1], "h": b[4][2][1] - b[4][0][1], "cy": (b[4][0][1] + b[4][2][1]) / 2, "c": b[3]} for b in rows if b[0] == d]
        assert got[d] == brute_lines(own)
        chosen = []
        for b in sorted(own, key=lambda b: (-b["c"], b["no"])):
            def iou(o, b=b):
                both = max(0, min(o["x1"], b["x1"]) - max(o["x0"], b["x0"])) * max(0, min(o["y1"], b["y1"]) - max(o["y0"], b["y0"]))
                return both / ((o["x1"] - o["x0"]) * (o["y1"] - o["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - both)

            if all(iou(o) < 0.3 for o in chosen):
                chosen.append(b)
        assert kept[d] == [b["no"] for b in chosen]


def test_regions(spark):
    found = L.regions(L.group_lines(spark.createDataFrame([box(1, 1, "a", y=40), box(1, 2, "b", y=72), box(1, 3, "c", y=400)], BLOCKS), "doc_id"), "doc_id")
    assert [(x.text, x.line_count) for x in found.orderBy("region_no").collect()] == [("a\nb", 2), ("c", 1)]


def test_boxes_of_every_order_are_scanned(spark):
    """Against the decoding in SQL of all zones, short first lines (class 4) and fillers in the state (class 7) too."""
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    expected = con.execute(f"{sql.TD3} SELECT o_orderkey, 'TD3', document_number, surname, structure_valid, check_digits_valid FROM d").fetchall()
    got = pages.boxes_scan_zone(spark, DIR).collect()
    assert sorted(tuple(x)[:-1] for x in got) == sorted(expected) and {x.ocr_confidence for x in got} == {0.9}
    assert {x.o_orderkey % 8 for x in got} == set(range(8)) and len(got) == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert {(x.o_orderkey % 8, x.structure_valid) for x in got if x.o_orderkey % 8 in (4, 7)} == {(4, True), (7, False)}


def test_labelled_fields(spark):
    pages = [
        [box(1, 1, "Issuing Authority", x=300, w=120), box(1, 2, "DAMMAM", x=100, w=80)],
        [box(2, 1, "issuingauthority / RIYADH"), box(2, 2, "12 JAN 2020", y=70)],
        [box(3, 1, "place of issue", y=40), box(3, 2, "Jeddah", y=70)],
        [box(4, 1, "place of issue", y=40), box(4, 2, "date of birth", y=70)],
        [box(5, 1, "الدسم محمد علي")],
        [box(6, 1, "جهة الإصدار", x=300, w=120), box(6, 2, "DAMMAM الدمام", x=100, w=80)],
        [box(7, 1, "nothing here")],
    ]
    df = spark.createDataFrame([b for p in pages for b in p], BLOCKS)
    got = {(x.doc_id, x.field): (x.value, x.source) for x in V.extract(df, "doc_id").collect()}
    assert got == {
        (1, "issuing_authority"): ("DAMMAM", "adjacent"),
        (2, "issuing_authority"): ("RIYADH", "merged"),
        (3, "issuing_authority"): ("Jeddah", "adjacent"),
        (5, "name_ar"): ("محمد علي", "merged"),
        (6, "issuing_authority"): ("DAMMAM", "adjacent"),
        (6, "issuing_authority_ar"): ("الدمام", "adjacent"),
    }
    assert [(x.doc_id, x.field) for x in V.missing_labels(df, "doc_id").where("doc_id <> 1 and doc_id <> 2 and doc_id <> 3").collect()] == [(4, "issuing_authority")]
    recovered = spark.createDataFrame([(4, "issuing_authority", "X", 0.9, "adjacent"), (1, "issuing_authority", "Y", 0.9, "adjacent"), (7, "name_ar", "Z", 0.5, "adjacent")], "doc_id long, field string, value string, confidence double, source string")
    filled = {(x.doc_id, x.field): x.value for x in V.fill_gaps(V.extract(df, "doc_id"), recovered, "doc_id").collect()}
    assert filled[(4, "issuing_authority")] == "X" and filled[(1, "issuing_authority")] == "DAMMAM" and (7, "name_ar") not in filled


def hits(spark):
    r = random.Random(2)
    at = datetime.datetime(2026, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=r.randrange(4000)), 1000 * k + i) for k in range(5) for i in range(60)]
    return rows, spark.createDataFrame(rows, "key long, ts timestamp, event_id long")


def expected(rows, limit, window):
    out, log = {}, {}
    for k, t, e in sorted(rows):
        own = [x for x in log.get(k, []) if (t - x).total_seconds() <= window]
        out[e] = len(own) < limit
        log[k] = [*own, t] if out[e] else own
    return out


def test_sliding_log_batch_and_stream(spark, tmp_path):
    rows, df = hits(spark)
    want = expected(rows, 4, 600)
    assert {x.event_id: x.allowed for x in R.sliding_log(df, 4, 600).collect()} == want and not all(want.values())
    log = R.SlidingLog(2, 60)
    assert [log.hit(0.0)[0], log.hit(1.0)[0], *log.hit(2.0)] == [True, True, False, 59]
    ordered = sorted(rows, key=lambda r: r[1])
    for i, part in enumerate((ordered[:150], ordered[150:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = SR.sliding_log_stream(stream, 4, 600).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {x.event_id: x.allowed for x in spark.table("limited").collect()} == want


def test_fixed_window(spark):
    rows, df = hits(spark)
    got = {x.event_id: x.allowed for x in R.fixed_window(df, 4, 600).collect()}
    count = {}
    for k, t, e in sorted(rows):
        b = (k, int(t.replace(tzinfo=datetime.UTC).timestamp()) // 600)
        count[b] = count.get(b, 0) + 1
        assert got[e] == (count[b] <= 4)


def test_redaction(spark):
    zone = "L898902C36UTO7408122F1204159ZE184226B"
    assert X.scrub({"Name": "x", "a": [zone, {"dob": None, "b": b"123"}], "n": 3}) == {"Name": "[REDACTED]", "a": ["[REDACTED]", {"dob": None, "b": "<3 bytes>"}], "n": 3}
    deep = {"a": 1}
    for _ in range(9):
        deep = {"a": deep}
    assert "[REDACTED]" in str(X.scrub(deep))
    df = spark.createDataFrame([('{"surname": "x", "k": "' + zone + '"}',), ("not json " + zone,), (None,)], "p string")
    assert [r[0] for r in df.select(X.redact_json(F.col("p"))).collect()] == ['{"surname": "[REDACTED]", "k": "[REDACTED]"}', "not json [REDACTED]", None]


def test_text(spark):
    df = spark.createDataFrame([("  José  d'Été<",), ("مُحَمَّد علي!",), ("x",), (None,), ("A12-٣٤",)], "t string")
    t = F.col("t")
    got = df.select(T.normalise_latin_name(t), T.normalise_arabic_name(t), T.fold_arabic(t), T.normalise_passport_number(t), T.has_arabic(t)).collect()
    assert got[0][0] == "JOSE D'ETE" and got[1][1] == "محمد علي" and got[1][2] == "محمدعلي" and got[2][0] is None and got[3][0] is None and got[4][3] == "A1234"
    assert spark.range(1).select(T.similarity(F.lit("abc"), F.lit("abd"))).first()[0] > 0.66


def test_sources(spark, tmp_path):
    named = spark.createDataFrame([(1, '{"rec_texts": [" a ", "", "b"], "rec_scores": [0.9], "dt_polys": [[[0,0],[1,0]]]}'), (2, '{"res": {"rec_texts": ["c"], "rec_scores": [0.5], "rec_polys": [[[1,2],[3]]]}}')], "doc_id long, payload string")
    assert [(x.doc_id, x.text, x.confidence, len(x.polygon)) for x in recognised.read_named(named).orderBy("doc_id", "block_no").collect()] == [(1, "a", 0.9, 2), (1, "b", 0.0, 0), (2, "c", 0.5, 0)]
    nested = spark.createDataFrame([(1, '[[[[[0,0],[1,0]],["a",0.9]],[[[0,0]],"bare"],[[[0,0]],["x","bad"]]]]')], "doc_id long, payload string")
    assert [(x.text, x.confidence) for x in recognised.read_nested(nested).orderBy("block_no").collect()] == [("a", 0.9), ("bare", 0.0), ("x", 0.0)]
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + bytes(500))
    (tmp_path / "b.exe").write_bytes(b"\xff\xd8\xff" + bytes(500))
    files = uploads.read_uploads(spark, f"file://{tmp_path}").withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
    assert {x.filename: (x.mime, x.error_code) for x in uploads.validate(files).collect()} == {"a.png": ("image/png", None), "b.exe": ("image/jpeg", "UNSUPPORTED_FORMAT")}

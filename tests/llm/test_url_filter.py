import duckdb

from vellum.llm import url_filter as U

URLS = [
    (1, "https://www.Example.com/en/7?x=1"), (2, "http://a.com/en/3"), (3, "ftp://b.net/de/8"), (4, "http://example.net/de/88#t"),
    (5, "http://notexample.net/de/8"), (6, "http://x.org/es/"), (7, None), (8, ""), (9, "no scheme/en/"), (10, "http://"),
    (11, "x://com/en/"), (12, "x://xcom/en/"), (13, "a://b://c.com/en/1"), (14, "http://casino-bonus.com/win/jackpot"),
    (15, "https://news.example.org/fr/1"), (16, "http://ünï.example.net/de/8/ß"), (17, "http://" + "a" * 50_000 + ".com/en/" + "b" * 50_000),
]


def frame(spark):
    return spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, html string")


def expected(url):
    host, path = U.split_url(url)
    best = None
    for kind, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    weights, bias = U.train()
    z = bias * max(len(host) + len(path), 1) + sum(weights[s] for s in U._slots(host, path))
    return (host, path, best[1] if best else None, best[0] if best else "block" if z > 0 else "allow")


def test_matches_python_and_sql(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(frame(spark)).collect()}
    assert got == {i: expected(u) for i, u in URLS}
    con = duckdb.connect()
    con.sql("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    assert {r[0]: r[1:] for r in con.sql(U.sql()).fetchall()} == got


def test_longest_rule_wins_and_verdicts(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(frame(spark)).collect()}
    assert got[1] == ("example.com/en/7", "allow") and got[2] == ("com/en/", "block")
    assert got[3] == ("net/de/", "allow") and got[4] == ("example.net/de/8", "block") and got[5] == ("net/de/", "allow")
    assert got[14] == (None, "block") and got[15] == (None, "allow") and got[12][0] is None


def test_model_separates_held_out_urls():
    rows = U.labelled_urls()
    weights, bias = U.train([r for i, r in enumerate(rows) if i % 4])
    right = 0
    for url, y in rows[::4]:
        slots = U._slots(*U.split_url(url))
        right += (bias * len(slots) + sum(weights[s] for s in slots) > 0) == bool(y)
    assert right / len(rows[::4]) > 0.9


def test_empty_table(spark):
    assert U.filter_urls(frame(spark).where("page_id < 0")).count() == 0

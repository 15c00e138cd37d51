"""Sources that plan by themselves, against files and a server on this machine."""

import json
import random
import threading
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

from bidlens.sources import feeds, paged
from test_sources import TENDER, feed

FIELDS = "codi_expedient codi_cpv denominacio data_publicacio_anunci enllac"
ROWS = [{"codi_expedient": f"e{i}", "codi_cpv": ("725" if i % 3 else "801") + f"{i:05}", "denominacio": "L'aigua 100%" if i % 5 == 0 else f"text {i}", "data_publicacio_anunci": f"2026-01-{i % 28 + 1:02}T00:00:00", **({"enllac": {"url": f"http://{i}"}} if i % 2 else {})} for i in range(53)]
NOTICES = [{"publication-number": f"{i}-2026", "publication-date": f"2026-02-{i % 28 + 1:02}+01:00", "notice-title": {"spa": f"T {i}"}} for i in range(61)]


class Service(BaseHTTPRequestHandler):
    asked: list = []
    files: dict = {}
    rows = list(range(47))

    def log_message(self, *args):
        pass

    def answer(self, data, status=200):
        raw = data if isinstance(data, bytes) else json.dumps(data).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(raw)

    def do_HEAD(self):
        self.answer(self.files[self.path])

    def do_GET(self):
        at = urllib.parse.urlparse(self.path)
        q = dict(urllib.parse.parse_qsl(at.query))
        self.asked.append((at.path, q))
        if at.path in self.files:
            a, b = (int(x) for x in self.headers["Range"][6:].split("-"))
            self.answer(self.files[at.path][a : b + 1], 206)
        elif at.path == "/rows":
            self.answer(self.rows[int(q["offset"]) :][: int(q["limit"])])
        elif at.path == "/regional":
            con = duckdb.connect()
            con.sql("CREATE TABLE r (k INT, codi_expedient VARCHAR, codi_cpv VARCHAR, denominacio VARCHAR, data_publicacio_anunci VARCHAR)")
            con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", [(k, *(x[c] for c in FIELDS.split()[:4])) for k, x in enumerate(ROWS)])
            found = [k for (k,) in con.sql(f"SELECT k FROM r WHERE {q.get('$where', 'true')} ORDER BY k").fetchall()]
            self.answer([{"n": str(len(found))}] if "$select" in q else [ROWS[k] for k in found][int(q["$offset"]) :][: int(q["$limit"])])
        else:
            self.answer({}, 404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, body))
        since = max([x.split(")")[0] for x in body["query"].split("publication-date>=")[1:]], default="")
        found = [n for n in NOTICES if n["publication-date"][:10].replace("-", "") >= since]
        self.answer({"totalNoticeCount": len(found), "notices": found[(body["page"] - 1) * body["limit"] :][: body["limit"]]})


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def drained(stream, checkpoint, column):
    rows = []
    stream.writeStream.foreachBatch(lambda b, _: rows.extend(r[0] for r in b.select(column).collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows


def test_a_long_chain_is_read_whole_in_batches_over_restarts(spark, tmp_path):
    at = lambda k: f"{tmp_path.as_uri()}/f{k}.atom"
    write = lambda k, to: (tmp_path / f"f{k}.atom").write_text(feed(f"2026-01-0{k}", TENDER, at(to)))
    for k in range(7, 0, -1):
        write(k, k - 1)
    paged.register(spark)
    run = lambda head=7: sorted(drained(spark.readStream.format("notice_chain").options(since="2025-01-01", most="3").load(at(head)), str(tmp_path / "c"), "updated"))
    day = lambda *ks: [f"2026-01-0{k}" for k in ks]
    assert [run(), run(), run(), run()] == [day(5, 6, 7), day(2, 3, 4), day(1), []]
    write(8, 7)
    assert run(8) == day(7, 8) and run(8) == []
    write(9, 8)
    write(1, 9)  # the chain comes back: a walk from an old cursor ends there, though it takes several batches
    stream = lambda: spark.readStream.format("notice_chain").options(since="2025-01-01", most="4").load(at(9))
    assert [sorted(drained(stream(), str(tmp_path / "d"), "updated")) for _ in range(4)] == [day(6, 7, 8, 9), day(2, 3, 4, 5), day(1), []]


def test_rows_until_a_short_page(spark, service, tmp_path):
    paged.register(spark)
    Service.rows = list(range(47))
    run = lambda most="1000": sorted(map(int, drained(spark.readStream.format("notice_rows").options(size="10", most=most).load(service + "/rows?offset={offset}&limit={limit}"), str(tmp_path / f"r{most}"), "row")))
    assert run() == list(range(47)) and run() == []
    Service.rows = list(range(60))
    assert run() == list(range(47, 60)) and run() == []
    Service.rows = list(range(61))
    assert run() == [60]
    assert [run("2"), run("2"), run("2"), run("2"), run("2")] == [list(range(20)), list(range(20, 40)), list(range(40, 60)), [60], []]
    Service.asked.clear()
    Service.rows = list(range(5000))
    assert len(drained(spark.readStream.format("notice_rows").options(size="10").load(service + "/rows?offset={offset}&limit={limit}"), str(tmp_path / "many"), "row")) == 5000
    assert len(Service.asked) <= 500 + 25  # a request for each page, and few to find the last


def test_rows_by_post(spark, service, tmp_path):
    paged.register(spark)
    body = json.dumps({"query": "(publication-date>={since})", "page": "PAGE", "limit": 7}).replace('"PAGE"', "{page}")
    stream = spark.readStream.format("notice_rows").options(size="7", rows="notices", body=body, since="20260215").load(service + "/search")
    got = {json.loads(r)["publication-number"] for r in drained(stream, str(tmp_path / "p"), "row")}
    assert got == {n["publication-number"] for n in NOTICES if n["publication-date"] >= "2026-02-15"}


def test_filters_reach_the_regional_service(spark, service):
    paged.register(spark)
    rows = lambda **k: spark.read.format("regional_service").options(**{"fields": FIELDS, "size": "10", "push": "true"} | k).load(service + "/regional")
    every = sorted(x["codi_expedient"] for x in ROWS)
    assert sorted(r[0] for r in rows().select("codi_expedient").collect()) == every
    cases = (
        (F.col("denominacio") == "L'aigua 100%", lambda x: x["denominacio"] == "L'aigua 100%", "denominacio = 'L''aigua 100%'"),
        (F.col("codi_cpv").startswith("801") & (F.col("data_publicacio_anunci") >= "2026-01-10T00:00:00"), lambda x: x["codi_cpv"] > "801" and x["data_publicacio_anunci"] >= "2026-01-10", "starts_with(codi_cpv, '801')"),
        (F.col("codi_expedient").isin("e3", "e4", "z'"), lambda x: x["codi_expedient"] in ("e3", "e4"), "in ('e3', 'e4', 'z''')"),
        (F.col("denominacio").contains("xt 1"), lambda x: "xt 1" in x["denominacio"], "contains(denominacio, 'xt 1')"),
        ((F.col("codi_cpv") > "801") & (F.length("denominacio") > 6), lambda x: x["codi_cpv"] > "801" and len(x["denominacio"]) > 6, "is not null"),
    )
    for condition, ok, said in cases:
        Service.asked.clear()
        assert sorted(r[0] for r in rows().where(condition).select("codi_expedient").collect()) == sorted(x["codi_expedient"] for x in ROWS if ok(x))
        assert all(said in q["$where"] for _, q in Service.asked) and all("codi_cpv >" not in q["$where"] for _, q in Service.asked)
        n = sum("$offset" in q for _, q in Service.asked)
        assert n == -(-sum(map(ok, ROWS)) // 10) or said == "is not null"
    # without pushing, one frame may be used as often as one likes
    asked = rows(push="false", where=paged.regional_where(["801"], ["l'aig"], "2026-01-05", ["denominacio"]))
    ok = lambda x: (x["codi_cpv"] > "801" or "L'aig" in x["denominacio"]) and x["data_publicacio_anunci"] >= "2026-01-05"
    late = F.col("data_publicacio_anunci") >= "2026-01-20"
    assert asked.count() == sum(map(ok, ROWS)) and asked.where(late).union(asked).count() == sum(map(ok, ROWS)) + sum(ok(x) and x["data_publicacio_anunci"] >= "2026-01-20" for x in ROWS)


def test_filters_reach_the_eu_service(spark, service):
    paged.register(spark)
    found = lambda: spark.read.format("eu_search").options(push="true", size="10", terms='cyber|say "x"', cpv="72|48").load(service + "/search")
    Service.asked.clear()
    late = found().where("published >= '2026-02-20' and number like '%1-2026'")
    want = sorted(n["publication-number"] for n in NOTICES if n["publication-date"] >= "2026-02-20" and n["publication-number"].endswith("1-2026"))
    assert sorted(r["number"] for r in late.collect()) == want
    assert all(body["query"] == r'(buyer-country=ESP) AND ((classification-cpv IN (72 48)) OR (FT~"cyber" OR FT~"say \"x\"")) AND (publication-date>=20260220)' for _, body in Service.asked)
    assert "T 7" in [r["title"] for r in feeds.eu_bodies(found()).collect()] and found().count() == len(NOTICES)
    assert paged.eu_query(since="2026-01-02") == "(buyer-country=ESP) AND (publication-date>=20260102)"
    with pytest.raises(Exception, match="ask for fewer"):
        spark.read.format("eu_search").options(most="50").load(service + "/search").count()


def test_members_of_archives_are_partitions(spark, service, tmp_path):
    paged.register(spark)
    draw = random.Random(1)
    bodies = {f"m{k}.atom": "é" + "".join(chr(draw.randrange(97, 123)) for _ in range(300_000 + k)) for k in range(6)}
    for name, method in (("a.zip", zipfile.ZIP_DEFLATED), ("b.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.writestr("readme.txt", "none" * 100_000)
            for k, body in bodies.items():
                z.writestr(k, body)
    Service.files = {f"/{n}": (tmp_path / n).read_bytes() for n in ("a.zip", "b.zip")}
    here = spark.read.format("notice_archive").option("piece", "65536").load(tmp_path.as_uri())
    there = spark.read.format("notice_archive").load(f"{service}/a.zip {service}/b.zip")
    for df in (here, there):
        assert df.rdd.getNumPartitions() == 12
        assert {(r["archive"][-5:], r["member"]): r["body"] for r in df.collect()} == {(a, m): b for a in ("a.zip", "b.zip") for m, b in bodies.items()}
    reader = paged.ArchiveReader({"path": (tmp_path / "b.zip").as_uri()})
    read, get = [], paged.fetch_range
    paged.fetch_range = lambda a, i, j: read.append(j - i) or get(a, i, j)
    try:
        members = reader.partitions()
        assert sum(read) < 5_000 and len(members) == 6  # of 2.2 MB
        read.clear()
        assert len(next(reader.read(members[0]))[2]) == 300_001 and sum(read) < 300_100
    finally:
        paged.fetch_range = get
    (tmp_path / "bad.zip").write_text("no archive")
    with pytest.raises(Exception, match="zip"):
        spark.read.format("notice_archive").load(tmp_path.as_uri()).collect()

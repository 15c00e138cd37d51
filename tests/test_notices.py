"""The notice model: scalar goldens, parity of counters and lists, partitions of statistics, rules, search, feeds, streams."""

from __future__ import annotations

import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from bidlens.functions import scalars, search
from bidlens.operators import analytics, export, inbox, maintenance, reconcile, rules
from bidlens.operators.grain import Filters, bins, entry, in_range, ranks
from bidlens.plans import registry
from bidlens.sources import feeds, paged
from bidlens.sources.adapter import AS_OF, matches, notices
from bidlens.streaming import changes


def values(spark, make, rows):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    n = len(frame.columns) - 1
    return [r[0] for r in frame.orderBy("i").select(make(*[F.col(f"c{k}") for k in range(n)])).collect()]


def test_scalars(spark):
    assert values(spark, scalars.months, [("48", "MON"), ("11", "ANN"), ("120", "DAY"), ("3", "YEAR"), ("12", None), ("0", "MON"), ("-5", "MON"), ("no consta", "MON"), (None, None)]) == [48, 132, 3.94, 36, 12, None, None, None, None]
    assert values(spark, scalars.amount, ["1.234.567,89", "1234,5", "1.234", "12 €", "x", None]) == [1234567.89, 1234.5, 1.234, 12, None, None]
    assert values(spark, scalars.cpv_codes, ["80533100-3", "72000000;80533100, 72000000", ""]) == [["80533100"], ["72000000", "80533100"], []]
    assert len(set(values(spark, scalars.company_key, ["S2 GRUPO, S.L.U.", "S2 Grupo S.L.U.", "S2 GRUPO, S.L.", "Sociedad Limitada S2 Grupo"]))) == 1
    assert values(spark, scalars.company_key, ["  S.L.  ", None]) == [None, None]
    assert values(spark, scalars.useful_title, ["Spain - Works - A title - more", "No dashes", "Spain - Title"]) == ["A title - more", "No dashes", "Title"]
    assert values(spark, scalars.text_norm, ["ÁÉ  ñç Ü", "é"]) == ["ae nc u", "e"]
    assert [str(x) for x in values(spark, scalars.wall_clock, ["2026-01-31T23:59:00-05:00", "31/12/2026", "31-12", "2026-02-30"])] == ["2026-01-31", "2026-12-31", "None", "None"]
    assert [str(x) for x in values(spark, lambda c: scalars.window_end(F.to_date(c), 6), ["2026-08-31", "2026-01-15"])] == ["2027-03-04", "2026-07-16"]
    stems = lambda t: values(spark, lambda c: scalars.stem(c, t), ["informacion", "de formacio", "ensayo", "ens dependents", "ñens x"])
    assert stems("formacio") == [False, True, False, False, False]
    assert stems("ens ") == [False, False, False, True, False]
    assert values(spark, feeds.duration_text, ["10/07/2026 a 09/01/2027", "24 mesos", "2 anys", "09/01/2027 a 10/07/2026", "?"]) == [6.01, 24, 24, None, None]
    assert values(spark, feeds.eu_state, ["pin-only", "can-standard", "cn-standard", "competition", None]) == ["previo", "adjudicada", "publicada", "publicada", "desconocido"]
    assert values(spark, feeds.region_of, ["es300", "ES511", "FR1", None]) == ["Madrid", "Cataluña", None, None]


def test_ranks_and_bins(spark):
    for n in (0, 1, 2, 3, 7, 50):
        v = sorted((k * 37) % 23 + 0.5 for k in range(n))
        frame = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        row = ranks(frame, "v").first()
        nearest = lambda p: v[round(p / 100 * (n - 1))] if v else None
        middle = (v[(n - 1) // 2] + v[n // 2]) / 2 if v else None
        assert tuple(row) == (n, middle, nearest(25), nearest(75))
        assert sum(r["n"] for r in bins(frame, "v", (5, 10, 20)).collect()) == n


@pytest.fixture(scope="module")
def model(spark, sf):
    n = notices(spark, sf).cache()
    return n, matches(n), entry(n, matches(n)), entry(n, matches(n), discarded=True)


def test_counters_equal_their_lists(model):
    _, _, _, every = model
    head = inbox.header(every, AS_OF, 0).first()
    for name, f in {"all_cases": Filters(), "open_cases": Filters(live=True), "closing": Filters(live=True, closing_days=7), "followed": Filters(review="siguiendo"), "discarded": Filters(review="descartado")}.items():
        assert head[name] == inbox.one_per_case(every, f, AS_OF).count() == inbox.count(every, AS_OF, f).first()[0], name


def test_pages_cover_the_list_once(model):
    every = model[3]
    pages = [r["notice_id"] for k in range(4) for r in inbox.inbox(every, AS_OF, order="score", limit=50, offset=50 * k).collect()]
    assert pages == [r["notice_id"] for r in inbox.inbox(every, AS_OF, order="score", limit=200).collect()] and len(set(pages)) == 200


def test_statistics_are_partitions(model):
    e = model[2]
    d = analytics.discounts(e)
    assert sum(r["cases"] for r in analytics.excluded(d).collect()) == d.count() == e.where("award > 0").select("case_key").distinct().count()
    kept = d.where("kind = 'kept'")
    assert sum(r["n"] for r in bins(kept, "discount", analytics.DISCOUNT_CUTS).collect()) == kept.count() == ranks(kept, "discount").first()["n"]
    assert sum(r["cases"] for r in analytics.latest_states(e).collect()) == e.select("case_key").distinct().count()
    assert sum(r["cases"] for r in analytics.procedures(e).collect()) == e.select("case_key").distinct().count()


def test_empty_tables_fail_nothing(spark, sf):
    n = notices(spark, sf).where("false")
    e = entry(n, matches(n))
    for f in (analytics.calendar_months, analytics.calendar_mean, analytics.calendar_cover, analytics.amount_top, analytics.cpv_divisions, analytics.buyers, analytics.procedures, analytics.latest_states):
        assert f(e).count() in (0, 1)
    assert inbox.inbox(e, AS_OF).count() == 0 and ranks(e, "money").first()["n"] == 0


def test_fusion_is_idempotent(model):
    n = model[0]
    bucket = F.floor(F.col("budget") / 5000)
    once = reconcile.fuse(n, bucket)
    assert sorted(map(tuple, once.select("notice_id", "group_key").collect()), key=str) == sorted(map(tuple, reconcile.fuse(once, bucket).select("notice_id", "group_key").collect()), key=str)


def test_search(spark):
    rows = spark.createDataFrame([(1, "El Niño está aquí"), (2, "the tender of works"), (3, "tendering works, of the"), (4, None)], "id int, t string").select("id", search.searchable(F.col("t")).alias("w"))
    w = F.col("w")
    find = lambda c: [r[0] for r in rows.where(c).orderBy("id").collect()]
    assert find(search.phrase(w, "nino")) == [1] and find(search.phrase(w, "NIÑO") & search.phrase(w, "esta")) == [1]
    assert find(search.prefix(w, "tender")) == [2, 3] and find(search.phrase(w, "tender")) == [2] and find(search.phrase(w, "of the")) == [3]
    assert find(search.phrase(w, "works") & ~search.phrase(w, "tender")) == [3]
    assert find(search.near(w, "works", "tender", 1)) == [2] and find(search.near(w, "the", "works", 0)) == []
    for bad in ("", '""', "-"):
        with pytest.raises(ValueError):
            search.phrase(w, bad)


def test_source_scope_is_by_prefix(spark):
    rows = spark.createDataFrame([("national:tenders",), (None,), ("eu",)], "source string").selectExpr("source", "'ciber x' AS text_norm", "cast(null AS string) AS region", "cast(null AS double) AS amount", "array('7250') AS cpv", "1 AS k")
    got = rules.evaluate(rows, rules.Profile("p", strong=("ciber",), sources=("national",))).select("source", "verdict").collect()
    assert {r[0]: r[1] for r in got} == {"national:tenders": "accepted", None: "source", "eu": "source"}
    assert rules.matches(rows, [rules.Profile("p", strong=("ciber",), cpv=("7250",))], "k").select("reason").first()[0] == "strong: ciber; cpv: 7250"


def test_decisions_reach_the_case_and_keep_what_is_null(spark):
    n = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "notice_id bigint, case_key string")
    old = spark.createDataFrame([(2, "siguiendo", "mine"), (3, "descartado", "x")], "notice_id bigint, state string, reason string")
    new = lambda *r: spark.createDataFrame(list(r), "notice_id bigint, state string, reason string")
    assert sorted(map(tuple, reconcile.decide(new((1, None, "why")), n, old).collect())) == [(1, "nuevo", "why"), (2, "siguiendo", "why"), (3, "descartado", "x")]
    with pytest.raises(Exception, match="no review state"):
        reconcile.decide(new((1, "odd", None)), n, old).collect()


def test_export(model, spark, tmp_path):
    e = model[3]
    table = export.rows(e, AS_OF, most=50).withColumn("title", F.concat(F.lit('a; "b" '), "title"))
    export.write(table, str(tmp_path / "x"))
    head = next((tmp_path / "x").glob("*.csv")).read_bytes().split(b"\n")[0]
    assert head.startswith(b"\xef\xbb\xbf") or head.startswith(b'"\xef\xbb\xbf')
    assert tuple(table.columns) == export.COLUMNS and len(export.COLUMNS) == 19


def test_snapshots_keep_what_is_read(spark):
    long = json.dumps({"state": "x", "note": "y" * 500})
    rows = spark.createDataFrame([(1, long), (2, '{"state": "z", "note": 1}'), (3, None)], "k int, s string")
    once = maintenance.trim_snapshots(rows, "s", ("state", "day"))
    assert [r["s"] for r in once.orderBy("k").collect()] == ['{"state":"x","day":null}', '{"state": "z", "note": 1}', None]


def test_months_are_checked(model):
    with pytest.raises(ValueError):
        in_range(model[0], "1996-13")


def test_profiles(spark):
    text = json.dumps({"profiles": [{"name": "x", "strong": ["ciber"], "weak": ["red"], "context": ["segur"], "exclude": ["limpieza"], "cpv": ["72500000"], "min_amount": 100, "regions": ["Madrid"]}]})
    (p,) = rules.load(text)
    rows = [
        (1, "servicio de ciberseguridad", "Madrid", 500.0, ["72510000"], "accepted", 4.0), (2, "limpieza ciber", "Madrid", 500.0, [], "excluded", None), (3, "ciber", "Murcia", 500.0, [], "region", None),
        (4, "ciber", None, None, None, "accepted", 3.0), (5, "ciber", "Madrid", 50.0, [], "amount", None), (6, "la red", "Madrid", 500.0, [], "weak only", None),
        (7, "la red segura", "Madrid", 200_000.0, [], "accepted", 2.5), (8, "nada", "Madrid", 500.0, ["72500000"], "no term", None),
    ]
    frame = spark.createDataFrame([(*r[:5], "s") for r in rows], "id int, text_norm string, region string, amount double, cpv array<string>, source string")
    got = {r["id"]: (r["verdict"], r["score"]) for r in rules.evaluate(frame, p).collect()}
    assert got == {r[0]: r[5:] for r in rows}
    assert rules.fingerprint([p]) != rules.fingerprint([rules.Profile(**{**p.__dict__, "min_amount": 1})])
    assert rules.query_terms([p]) == ["ciber"] and rules.warnings(p) == ["red"] and rules.cpv_prefix("72500000") == "725" and rules.cpv_prefix("30000000") == "30"
    for bad in ('[{"name": "a"}]', '[{"name": "a", "weak": ["b"]}]', '[{"name": "a", "strong": [""]}]', '[{"name": "a", "strong": ["b"], "active": false}]', '[{"nome": "a"}]'):
        with pytest.raises((ValueError, TypeError)):
            rules.load(bad)


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:b" xmlns:cac="urn:a" xmlns:at="urn:t"><updated>2026-01-02T00:00:00Z</updated>
<entry><id>e1</id><updated>2026-01-01T10:00:00+01:00</updated><title>One</title><link href="http://x/1"/><cac:ContractFolderStatus><cbc:ContractFolderID> 12/2026 </cbc:ContractFolderID><cbc:ContractFolderStatusCode>PUB</cbc:ContractFolderStatusCode>
<cac:LocatedContractingParty><cac:Party><cac:PartyName><cbc:Name>Buyer  A</cbc:Name></cac:PartyName></cac:Party></cac:LocatedContractingParty>
<cac:ProcurementProject><cbc:Name>Work</cbc:Name><cac:BudgetAmount><cbc:TaxExclusiveAmount currencyID="EUR">1000.50</cbc:TaxExclusiveAmount></cac:BudgetAmount><cac:RequiredCommodityClassification><cbc:ItemClassificationCode>72500000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification>
<cac:RealizedLocation><cbc:CountrySubentityCode>ES300</cbc:CountrySubentityCode></cac:RealizedLocation><cac:PlannedPeriod><cbc:DurationMeasure unitCode="ANN">2</cbc:DurationMeasure></cac:PlannedPeriod></cac:ProcurementProject>
<cac:ProcurementProjectLot><cbc:ID>1</cbc:ID><cac:ProcurementProject><cbc:Name>Lot one</cbc:Name></cac:ProcurementProject></cac:ProcurementProjectLot>
<cac:TenderingProcess><cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-02-01</cbc:EndDate><cbc:EndTime>14:00:00+01:00</cbc:EndTime></cac:TenderSubmissionDeadlinePeriod></cac:TenderingProcess></cac:ContractFolderStatus></entry>
<entry><id>e2</id><updated>2026-01-01</updated><title>Two</title><cac:ContractFolderStatus><cbc:ContractFolderStatusCode>XX</cbc:ContractFolderStatusCode></cac:ContractFolderStatus></entry>
<at:deleted-entry ref="e3"/></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip/a.zip", "w") as z:
        z.writestr("b.atom", ATOM)
        z.writestr("readme.txt", "no feed")
    members = paged.register(spark).read.format("notice_archive").load((tmp_path / "zip").as_uri())
    rows = {r["external_id"]: r for r in feeds.atom_bodies(members).collect()}
    one = rows["e1"]
    assert set(rows) == {"e1", "e2"} and rows["e2"]["state"] == "desconocido" and rows["e2"]["title"] == "Two"
    assert (one["case_no"], one["buyer"], one["state"], one["budget"], one["cpv"], one["region"], one["months"], one["deadline"], one["lot"], one["detail_url"]) == ("12/2026", "Buyer A", "publicada", 1000.5, ["72500000"], "Madrid", 24, "2026-02-01T14:00:00", "1", "http://x/1")
    page = {"notices": [{"publication-number": "1-2026", "publication-date": "2026-01-05+01:00", "notice-type": "cn-standard", "classification-cpv": ["72", "72"], "notice-title": {"eng": ["A"], "spa": ["B"]}, "buyer-name": {"cat": ["C"]}, "total-value": 5}, {"notice-type": "can"}]}
    (tmp_path / "eu.json").write_text(json.dumps(page))
    (eu,) = feeds.eu_notices(spark, str(tmp_path / "eu.json")).collect()
    assert (eu["title"], eu["buyer"], eu["state"], str(eu["published"]), eu["cpv"]) == ("B", "C", "publicada", "2026-01-05", ["72"])


def test_stream_in_two_batches_equals_one(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("a", 4, "y"), ("b", 5, "x"), ("a", 6, "x")]
    schema = "key string, seq bigint, fingerprint string"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["seq"]: r["outcome"] for r in changes.run_once(spark, stream).collect()}
    assert got == {1: "nueva", 2: "igual", 3: "nueva", 4: "actualizada", 5: "igual", 6: "actualizada"}


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda rows: sorted(tuple(f"{float(x):.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    for name in ("regions_awarded_money", "inbox_urgency", "expiry_windows", "awardee_ranking", "discount_stats", "bid_window_bins", "cycle_stats", "fusion_result", "reviews_propagated", "profile_matches", "full_text_not", "stream_change_detection"):
        frame = registry.queries()[name](spark, sf)
        cursor = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert plain(frame.select(*columns).collect()) == plain(cursor.fetchall()), name

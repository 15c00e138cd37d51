"""Sources over files of the shapes that the services give, stored tables, and re-evaluation on a stream."""

import json
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from bidlens.functions import scalars
from bidlens.operators import rules, storage
from bidlens.sources import feeds, paged, regional
from bidlens.streaming import matching

PARTY = '<cac:LocatedContractingParty><cac:Party><cac:PartyIdentification><cbc:ID schemeName="DIR3">L01</cbc:ID></cac:PartyIdentification><cac:PartyIdentification><cbc:ID schemeName="NIF">b12345678</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Buyer</cbc:Name></cac:PartyName></cac:Party></cac:LocatedContractingParty>'
NOTICE = "".join(f"<ext:ValidNoticeInfo><ext:AdditionalPublicationStatus><ext:PublicationMediaName>{m}</ext:PublicationMediaName><ext:AdditionalPublicationDocumentReference><cbc:IssueDate>{d}</cbc:IssueDate></ext:AdditionalPublicationDocumentReference></ext:AdditionalPublicationStatus></ext:ValidNoticeInfo>" for m, d in (("DOUE", "2026-01-01"), ("Perfil del Contratante", "2026-01-07+01:00"), ("perfil", "2026-01-05")))
LINKS = "".join(f"<cac:{k}DocumentReference><cac:Attachment><cac:ExternalReference><cbc:URI>{u}</cbc:URI></cac:ExternalReference></cac:Attachment></cac:{k}DocumentReference>" for k, u in (("Additional", "http://c"), ("Legal", "http://a"), ("Technical", "http://b"), ("Technical", "http://a")))
PROJECT = '<cac:ProcurementProject><cbc:Name>Work</cbc:Name><cbc:TypeCode>2</cbc:TypeCode><cac:RequiredCommodityClassification><cbc:ItemClassificationCode>72500000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification><cac:RealizedLocation><cbc:CountrySubentity>Madrid</cbc:CountrySubentity><cbc:CountrySubentityCode>ES300</cbc:CountrySubentityCode></cac:RealizedLocation><cac:PlannedPeriod><cbc:StartDate>2026-03-01</cbc:StartDate><cbc:EndDate>2027-03-01</cbc:EndDate></cac:PlannedPeriod></cac:ProcurementProject>'
TENDER = f"<entry><id>http://x/1</id><updated>2026-01-02</updated><title>T</title><cac:ContractFolderStatus><cbc:ContractFolderStatusCode>PUB</cbc:ContractFolderStatusCode>{PARTY}{PROJECT}<cac:TenderingProcess><cbc:ProcedureCode>9</cbc:ProcedureCode></cac:TenderingProcess>{LINKS}{NOTICE}</cac:ContractFolderStatus></entry>"
EARLY = f"<entry><id>http://x/7/</id><updated>2026-01-02</updated><title>T</title><ext:PreliminaryMarketConsultationStatus><cbc:PreliminaryMarketConsultationID>C 7</cbc:PreliminaryMarketConsultationID><cbc:ConsultationName>Ask</cbc:ConsultationName><cbc:LimitDate>2026-02-01</cbc:LimitDate>{PARTY}{PROJECT}{NOTICE}<ext:GeneralDocument><ext:GeneralDocumentDocumentReference><cac:Attachment><cac:ExternalReference><cbc:URI>http://g</cbc:URI></cac:ExternalReference></cac:Attachment></ext:GeneralDocumentDocumentReference></ext:GeneralDocument></ext:PreliminaryMarketConsultationStatus></entry>"


def feed(updated, entries, following=None):
    link = f'<link rel="next" href="{following}"/>' if following else ""
    return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:b" xmlns:cac="urn:a" xmlns:ext="urn:e"><updated>{updated}</updated>{link}{entries}</feed>'


def test_tenders_and_consultations(spark, tmp_path):
    (tmp_path / "a.atom").write_text(feed("2026-01-03", TENDER))
    (tmp_path / "c.atom").write_text(feed("2026-01-03", EARLY + "<entry><id>http://x/8</id></entry>"))
    (one,) = feeds.atom(spark, str(tmp_path / "a.atom")).collect()
    assert (one["buyer_id"], one["contract_type"], one["procedure"], one["place"], str(one["published"]), str(one["starts_on"])) == ("B12345678", "Servicios", "Abierto simplificado", "Madrid", "2026-01-05", "2026-03-01")
    assert one["documents"] == ["http://a", "http://b", "http://c"]
    (early,) = feeds.consultations(spark, str(tmp_path / "c.atom")).collect()
    assert (early["external_id"], early["title"], early["summary"], early["state"], early["deadline"], early["buyer_id"], early["cpv"], early["documents"]) == ("consultas_previas:7", "Ask", "Work", "previo", "2026-02-01", "B12345678", ["72500000"], ["http://g"])
    bodies = spark.createDataFrame([(feed("2026-01-03", TENDER + TENDER),), (None,)], "body string")
    assert [tuple(r) for r in feeds.atom_bodies(bodies).collect()] == [tuple(one)] * 2


def test_eu_durations_and_terms(spark, tmp_path):
    page = {"notices": [
        {"publication-number": "1", "notice-type": "prior-x", "duration-period-value-lot": ["24", "3", None], "duration-period-unit-lot": ["MONTH", "YEAR"], "contract-nature": ["services", "services", "odd"], "procedure-type": "open"},
        {"publication-number": "2", "duration-period-value-lot": ["24"]},
        {"publication-number": "3"},
    ]}
    (tmp_path / "eu.json").write_text(json.dumps(page))
    got = {r["external_id"]: (r["state"], r["months"], r["contract_type"], r["procedure"]) for r in feeds.eu_notices(spark, str(tmp_path / "eu.json")).collect()}
    assert got == {"1": ("previo", 36, "Servicios · odd", "Abierto"), "2": ("desconocido", 24, None, None), "3": ("desconocido", None, None, None)}


def test_dates_as_written(spark):
    """Against the standard library's readers, form by form."""
    from datetime import datetime

    def plain(text):
        t = text.strip().replace("Z", "+00:00")
        for form in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%d/%m/%Y"):
            try:
                return datetime.strptime(t, form).isoformat()
            except ValueError:
                pass
        try:
            return datetime.fromisoformat(t).isoformat()
        except ValueError:
            return None

    forms = ["2026-03-13T13:00:00.000", "2026-03-13T13:00:00.250", "2026-03-13T13:00:00+01:00", "2026-03-13T13:00:00Z", "2026-03-13T13:00", "2026-03-13", "20240131", "20240131T1015", "31/01/2024", "1/2/2024", "31/01/2024 10:00", "2026-03-13 07:30", "2026-02-30", "2026-03-13T25:00", "31-12", "", " 2026-03-13 ", "2026-03-13T13:00:00-05:30", "2026-03-13T13", "30/02/2024", "text"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(forms)], "k int, t string").orderBy("k").select(scalars.iso_instant(F.col("t"))).collect()]
    assert got == [plain(t) if t else None for t in forms]


def test_deadlines_unknown_codes_and_regions(spark, tmp_path):
    end = lambda d, t: f"<cac:TenderingProcess><cbc:ProcedureCode>77</cbc:ProcedureCode><cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>{d}</cbc:EndDate>{t and f'<cbc:EndTime>{t}</cbc:EndTime>'}</cac:TenderSubmissionDeadlinePeriod></cac:TenderingProcess>"
    bare = '<cac:TenderingProcess><cbc:ProcedureCode>9</cbc:ProcedureCode></cac:TenderingProcess>'
    odd = [TENDER.replace(bare, end(d, t)).replace("<cbc:TypeCode>2<", "<cbc:TypeCode>55<") for d, t in (("2024-05-01+02:00", "10:00:00+02:00"), ("2024-05-01Z", "23:59:00Z"), ("2024-05-01", ""))]
    (tmp_path / "o.atom").write_text(feed("2026-01-03", "".join(odd)))
    got = [(r["deadline"], r["procedure"], r["contract_type"]) for r in feeds.atom(spark, str(tmp_path / "o.atom")).collect()]
    assert got == [(d, "77", "55") for d in ("2024-05-01T10:00:00", "2024-05-01T23:59:00", "2024-05-01")]
    want = "Galicia,Asturias,Cantabria,País Vasco,Navarra,La Rioja,Aragón,Madrid,Castilla y León,Castilla-La Mancha,Extremadura,Cataluña,Comunidad Valenciana,Islas Baleares,Andalucía,Murcia,Ceuta,Melilla,Canarias".split(",")
    assert list(feeds.REGIONS.values()) == want and len(want) == 19
    assert spark.range(1).select(feeds.region_of(F.lit(" es523 "))).first()[0] == "Comunidad Valenciana"


def test_eu_fields_in_all_forms(spark, tmp_path):
    page = {"notices": [
        {"publication-number": "1-2026", "publication-date": "2026-01-05+01:00", "buyer-name": {"cat": ["C", "C", "D"]}, "notice-title": {"eng": ["A"], "spa": ["B", "B2"]}, "description-proc": None, "description-lot": {"spa": ["x", "x"]}, "total-value": 5.5, "estimated-value-proc": ["1.234,5", "9"], "winner-name": ["W", "W", "V"], "winner-decision-date": ["2026-01-02"], "deadline-receipt-request": ["2026-02-01T10:00:00+01:00", "x"], "links": {"html": {"ENG": "http://e"}, "pdf": {"SPA": "http://p"}}, "procedure-type": "unlisted"},
        {"publication-number": "2-2026", "notice-title": "plain", "buyer-name": ["a", "b", "a"], "winner-name": {"fra": []}, "links": {"html": {}}},
    ]}
    (tmp_path / "eu.json").write_text(json.dumps(page))
    a, b = feeds.eu_notices(spark, str(tmp_path / "eu.json")).orderBy("external_id").collect()
    assert (a["title"], a["buyer"], a["summary"], a["budget"], a["estimated_value"], a["awardee"], str(a["awarded_on"]), str(a["deadline"])) == ("B · B2", "C · D", "x", 5.5, 1234.5, "W · V", "2026-01-02", "2026-02-01")
    assert (a["case_no"], a["detail_url"], a["documents"], a["procedure"], str(a["published"])) == ("1-2026", "http://e", ["http://p"], "unlisted", "2026-01-05")
    assert (b["title"], b["buyer"], b["awardee"], b["detail_url"], b["documents"]) == ("plain", "a · b", None, feeds.EU_DETAIL + "2-2026", [])


def test_regional_rows(spark, tmp_path):
    rows = [
        {"id_intern": "a", "numero_lot": "2", "codi_cpv": "72500000-0", "denominacio": "Servei", "fase_publicacio": "Anunci de licitació", "pressupost_licitacio_sense": "", "pressupost_licitacio_sense_1": "10.5", "enllac_publicacio": {"url": "http://a"}, "url_json_previ": "http://p", "url_json_licitacio": "no", "durada_contracte": "1/7/2026 fins 31-12-2026", "data_publicacio_anunci": "2026-02-01T00:00:00"},
        {"codi_expedient": "b", "numero_lot": "0", "resultat": "Desert", "objecte_contracte": "o'Ciber x", "durada_contracte": "31/02/2026 a 01/03/2026", "data_publicacio_anunci": "2026-01-01T00:00:00"},
        {"denominacio": "ciber"},
    ]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(rows))
    got = {r["external_id"]: r for r in regional.notices(spark, str(path)).collect()}
    a, b = got["a#2"], got["b"]
    assert set(got) == {"a#2", "b"} and (a["state"], a["budget"], a["detail_url"], a["documents"], a["lot"], a["months"], str(a["starts_on"]), str(a["ends_on"])) == ("publicada", 10.5, "http://a", ["http://p"], "2", 6.01, "2026-07-01", "2026-12-31")
    assert (b["state"], b["lot"], b["months"], b["starts_on"], b["case_no"]) == ("resuelta", None, None, None, "b")
    ids = lambda **k: sorted(r[0] for r in regional.notices(spark, str(path), **k).select("external_id").collect())
    assert ids(cpv=["725"]) == ["a#2"] and ids(terms=["o'ciber"]) == ["b"] and ids(cpv=["725"], terms=["ciber"]) == ["a#2", "b"] and ids(since="2026-01-15") == ["a#2"] and ids(terms=["none"]) == []


def test_pages_and_increments(spark, tmp_path):
    for k in (1, 2, 4):
        (tmp_path / f"p{k}.json").write_text(f"body {k}")
    paged.register(spark)
    pages = spark.read.format("notice_pages").option("pages", 4).load(f"{tmp_path.as_uri()}/p{{page}}.json")
    assert sorted(map(tuple, pages.collect())) == [(1, "body 1"), (2, "body 2"), (4, "body 4")]
    assert [paged.page_count(n) for n in (0, 1, 250, 251, 99_999)] == [0, 1, 1, 2, 60]
    today = date(2026, 3, 31)
    assert [str(paged.increment_since(c, today)) for c in ("2026-03-10", None, "odd")] == ["2026-03-07", "2026-03-01", "2026-03-01"]


def test_chain_stops_at_the_cursor(spark, tmp_path):
    at = lambda k: f"{tmp_path.as_uri()}/f{k}.atom"
    write = lambda k, day, to: (tmp_path / f"f{k}.atom").write_text(feed(day, TENDER, at(to)))
    for k in (4, 3, 2, 1):
        write(k, f"2026-01-0{k}", k - 1)
    paged.register(spark)

    def run(head, name, **options):
        stream = spark.readStream.format("notice_chain").options(**options).load(at(head))
        rows = []
        stream.writeStream.foreachBatch(lambda b, _: rows.extend(r[0] for r in b.select("updated").collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(rows)

    assert run(3, "s1", since="2026-01-02") == ["2026-01-02", "2026-01-03"]
    assert run(3, "s2") == ["2026-01-03"] and run(3, "s3", first="2") == ["2026-01-02", "2026-01-03"]
    assert run(4, "s4", since="2025-01-01", most="3") == ["2026-01-02", "2026-01-03", "2026-01-04"]
    write(1, "2026-01-01", 4)
    assert run(4, "s5", since="2025-01-01") == [f"2026-01-0{k}" for k in (1, 2, 3, 4)]


def test_stored_rows_come_back(spark):
    rows = spark.createDataFrame([(1, "Áa", ["72", "48"], ["http://a"], 0.0, 5.0, "u"), (2, None, [], [], None, None, "v")], "k int, title string, cpv array<string>, documents array<string>, award double, budget double, updated string")
    stored = storage.stored(rows, ("title", "cpv"), ("award", "budget"))
    got = {r["k"]: r for r in stored.collect()}
    assert (got[1]["search_text"], got[1]["text_norm"], got[1]["cpv"], got[1]["reference_amount"]) == ("Áa \n72 48", "aa 72 48", "72 48", 5.0) and (got[2]["search_text"], got[2]["reference_amount"]) == ("", None)
    back = {r["k"]: (r["cpv"], r["documents"]) for r in storage.loaded(stored).collect()}
    assert back == {1: (["72", "48"], ["http://a"]), 2: ([], [])}
    odd = spark.createDataFrame([("72", "{no"), (None, None)], "cpv string, documents string")
    assert [tuple(r) for r in storage.loaded(odd).collect()] == [(["72"], []), ([], [])]
    again = {r["k"]: r["fingerprint"] for r in storage.stored(rows.withColumn("updated", F.lit("w")), ("title",), ("award",)).collect()}
    assert again == {k: r["fingerprint"] for k, r in got.items()}


def test_tables_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9), (None, 8), ("c", 7)], "k string, v int")
    assert sorted(map(tuple, storage.put(old, new, "k").collect()), key=str) == [("a", 1), ("b", 9), ("c", 7), (None, 8)]
    wide = StructType().add("k", StringType()).add("note", StringType())
    once = storage.migrated(old, wide)
    assert once.columns == ["k", "v", "note"] and storage.migrated(once, wide).schema == once.schema
    assert [scalars.clamped(x, 1, 60) for x in (0, 5, 61)] == [1, 5, 60]


def test_stream_judges_what_changed(spark, tmp_path):
    schema = "key string, fingerprint string, at int, text_norm string, region string, amount double, source string, cpv array<string>"
    row = lambda key, mark, at, text: (key, mark, at, text, None, None, "s", [])
    batches = [[row("a", "1", 1, "ciber"), row("b", "1", 1, "nada"), row("a", "0", 0, "nada")], [row("a", "1", 2, "not judged"), row("b", "2", 2, "ciber red")], [row("a", "2", 3, "nada"), row("b", "3", 3, "ciber")]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["batch"], r["key"], r["change"]) for r in matching.run_once(spark, stream, [rules.Profile("p", strong=("ciber", "red"))], "at").collect())
    assert got == [(0, "a", "created"), (1, "b", "created"), (2, "a", "removed"), (2, "b", "updated")]


def test_version_parts(spark):
    for text, parts in (("v1.10", [1, 10]), ("V2", [2]), (" v1.x.3b ", [1, 0, 3]), ("", [0])):
        assert spark.range(1).select(scalars.version_parts(F.lit(text)).alias("p")).first()["p"] == parts

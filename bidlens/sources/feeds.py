"""Tender feeds as DataFrames: ATOM files and bodies, and JSON of the EU and regional services. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.scalars import amount, any_language, clean, cpv_codes, first_of, months, tax_id, translated, wall_clock

#: State codes of the national feed.
STATES = {"PRE": "previo", "PUB": "publicada", "EV": "evaluacion", "ADJ": "adjudicada", "RES": "resuelta", "ANUL": "anulada"}
#: Regions by the first four characters of the territorial code.
REGIONS = {
    "ES11": "Galicia", "ES12": "Asturias", "ES13": "Cantabria", "ES21": "País Vasco", "ES22": "Navarra", "ES23": "La Rioja", "ES24": "Aragón",
    "ES30": "Madrid", "ES41": "Castilla y León", "ES42": "Castilla-La Mancha", "ES43": "Extremadura", "ES51": "Cataluña", "ES52": "Comunidad Valenciana",
    "ES53": "Islas Baleares", "ES61": "Andalucía", "ES62": "Murcia", "ES63": "Ceuta", "ES64": "Melilla", "ES70": "Canarias",
}
#: Kinds of contract of the national feed.
CONTRACT_TYPES = {
    "1": "Suministros", "2": "Servicios", "3": "Obras", "7": "Administrativo especial", "8": "Privado", "21": "Gestión de servicios públicos",
    "22": "Concesión de servicios", "31": "Concesión de obras públicas", "32": "Concesión de obras", "40": "Colaboración público-privada", "50": "Patrimonial",
}
#: Procedures of the national feed.
PROCEDURES = {
    "1": "Abierto", "2": "Restringido", "3": "Negociado sin publicidad", "4": "Negociado con publicidad", "5": "Diálogo competitivo", "6": "Contrato menor",
    "7": "Basado en acuerdo marco", "8": "Concurso de proyectos", "9": "Abierto simplificado", "10": "Asociación para la innovación",
    "11": "Derivado de asociación para la innovación", "12": "Basado en sistema dinámico de adquisición", "13": "Licitación con negociación",
    "100": "Normas internas", "999": "Otros",
}
#: Kinds of contract and procedures of the EU service.
EU_CONTRACT_TYPES = {"services": "Servicios", "supplies": "Suministros", "works": "Obras", "combined": "Mixto"}
EU_PROCEDURES = {
    "open": "Abierto", "restricted": "Restringido", "neg-w-call": "Negociado con publicidad", "neg-wo-call": "Negociado sin publicidad",
    "comp-dial": "Diálogo competitivo", "innovation": "Asociación para la innovación", "comp-tend": "Licitación con negociación",
    "oth-mult": "Otro (varias fases)", "oth-single": "Otro (fase única)", "negotiated": "Negociado",
}

_PERIOD = "struct<DurationMeasure:struct<_VALUE:string,_unitCode:string>,StartDate:string,EndDate:string>"
_PROJECT = f"struct<Name:string,TypeCode:string,BudgetAmount:struct<TaxExclusiveAmount:string,EstimatedOverallContractAmount:string>,RequiredCommodityClassification:array<struct<ItemClassificationCode:string>>,RealizedLocation:struct<CountrySubentityCode:string,CountrySubentity:string>,PlannedPeriod:{_PERIOD}>"
_PARTY = "struct<Party:struct<PartyName:struct<Name:string>,PartyIdentification:array<struct<ID:string>>>>"
_LINKED = "struct<Attachment:struct<ExternalReference:struct<URI:string>>>"
_PUBLISHED = "array<struct<AdditionalPublicationStatus:array<struct<PublicationMediaName:string,AdditionalPublicationDocumentReference:array<struct<IssueDate:string>>>>>>"
_HEAD = "id string, updated string, title string, summary string, link struct<_href:string>"
ENTRY = f"""{_HEAD}, _corrupt string,
ContractFolderStatus struct<ContractFolderID:string,ContractFolderStatusCode:string,
LocatedContractingParty:{_PARTY},ProcurementProject:{_PROJECT},ValidNoticeInfo:{_PUBLISHED},
LegalDocumentReference:array<{_LINKED}>,TechnicalDocumentReference:array<{_LINKED}>,AdditionalDocumentReference:array<{_LINKED}>,
ProcurementProjectLot:array<struct<ID:string,ProcurementProject:{_PROJECT}>>,
TenderingProcess:struct<ProcedureCode:string,TenderSubmissionDeadlinePeriod:struct<EndDate:string,EndTime:string>>,
TenderResult:array<struct<AwardDate:string,WinningParty:struct<PartyName:struct<Name:string>>,AwardedTenderedProject:struct<LegalMonetaryTotal:struct<TaxExclusiveAmount:string>>>>>"""

CONSULTATION = f"""{_HEAD}, _corrupt string,
PreliminaryMarketConsultationStatus struct<PreliminaryMarketConsultationID:string,PreliminaryMarketConsultationStatusCode:string,ConsultationName:string,
PlannedDate:string,LimitDate:string,LocatedContractingParty:{_PARTY},ProcurementProject:{_PROJECT},ValidNoticeInfo:{_PUBLISHED},
GeneralDocument:array<struct<GeneralDocumentDocumentReference:{_LINKED}>>>"""


def lookup(codes: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), key)


def named(codes: dict[str, str], key: Column) -> Column:
    """The name of a code; a code that isn't listed stands for itself."""
    return F.coalesce(lookup(codes, key), key)


def local_end(day: Column, clock: Column) -> Column:
    """A day and a time of day as one text, both without their offsets; the day alone where there is no time."""
    bare = lambda c: F.substring_index(F.substring_index(F.trim(c), "+", 1), "Z", 1)
    return F.concat(bare(day), F.coalesce(F.concat(F.lit("T"), F.nullif(bare(clock), F.lit(""))), F.lit("")))


def region_of(code: Column) -> Column:
    return lookup(REGIONS, F.substring(F.upper(F.trim(code)), 1, 4))


def first_published(info: Column) -> Column:
    """The first day on which a medium with ``perfil`` in its name published it, without an offset."""
    places = F.filter(F.flatten(F.transform(info, lambda x: F.coalesce(x["AdditionalPublicationStatus"], F.array()))), lambda x: F.lower(x["PublicationMediaName"]).contains("perfil"))
    days = F.flatten(F.transform(places, lambda x: F.coalesce(x["AdditionalPublicationDocumentReference"]["IssueDate"], F.array())))
    return F.array_min(F.transform(F.filter(days, lambda d: d.isNotNull() & (d != "")), lambda d: F.substring_index(d, "+", 1)))


def addresses(*references: Column) -> Column:
    """The addresses of documents, each once, in order."""
    found = F.flatten(F.array(*[F.coalesce(r["Attachment"]["ExternalReference"]["URI"], F.array().cast("array<string>")) for r in references]))
    return F.array_distinct(F.filter(F.transform(found, clean), lambda x: x.isNotNull()))


_XML = {"rowTag": "entry", "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_"}


def consultations(spark: SparkSession, path: str, source: str = "national:consultations") -> DataFrame:
    """Preliminary consultations of ATOM files: always ``previo``, without a budget, their limit a day; other entries are left out."""
    raw = spark.read.format("xml").schema(CONSULTATION).options(**_XML).load(path)
    c = F.col("PreliminaryMarketConsultationStatus")
    project, party = c["ProcurementProject"], c["LocatedContractingParty"]["Party"]
    codes = project["RequiredCommodityClassification"]["ItemClassificationCode"]
    return raw.where("_corrupt is null and id is not null and PreliminaryMarketConsultationStatus is not null").select(
        F.lit(source).alias("source"),
        F.concat(F.lit("consultas_previas:"), F.element_at(F.split(F.regexp_replace("id", "/+$", ""), "/"), -1)).alias("external_id"),
        clean(c["PreliminaryMarketConsultationID"]).alias("case_no"),
        clean(party["PartyName"]["Name"]).alias("buyer"),
        tax_id(party["PartyIdentification"]["ID"]).alias("buyer_id"),
        F.coalesce(clean(c["ConsultationName"]), clean(project["Name"]), clean(F.col("title"))).alias("title"),
        clean(project["Name"]).alias("summary"),
        cpv_codes(F.array_join(codes, " ")).alias("cpv"),
        F.lit("Consulta preliminar de mercado").alias("procedure"),
        named(CONTRACT_TYPES, project["TypeCode"]).alias("contract_type"),
        F.lit("previo").alias("state"),
        wall_clock(F.coalesce(c["PlannedDate"], first_published(c["ValidNoticeInfo"]))).alias("published"),
        c["LimitDate"].alias("deadline"),
        F.col("updated"),
        region_of(project["RealizedLocation"]["CountrySubentityCode"]).alias("region"),
        clean(project["RealizedLocation"]["CountrySubentity"]).alias("place"),
        F.col("link._href").alias("detail_url"),
        addresses(c["GeneralDocument"]["GeneralDocumentDocumentReference"]).alias("documents"),
    )


def atom(spark: SparkSession, path: str, source: str = "national:tenders") -> DataFrame:
    """One row per entry. A broken entry is left out and tombstones are no entries; prefixes of names are ignored."""
    return _tenders(spark.read.format("xml").schema(ENTRY).options(**_XML).load(path), source)


def atom_bodies(feeds: DataFrame, body: str = "body", source: str = "national:tenders") -> DataFrame:
    """The same of feeds that a column holds, as a stream of them does."""
    options = {k: v for k, v in _XML.items() if k != "rowTag"}
    raw = feeds.select(F.explode(F.from_xml(body, f"entry array<struct<{ENTRY}>>", options)["entry"]).alias("e")).select("e.*")
    return _tenders(raw, source)


def _tenders(raw: DataFrame, source: str) -> DataFrame:
    folder = F.col("ContractFolderStatus")
    project, lots = folder["ProcurementProject"], folder["ProcurementProjectLot"]
    end = folder["TenderingProcess"]["TenderSubmissionDeadlinePeriod"]
    result = F.get(folder["TenderResult"], F.lit(0))
    codes = F.array_distinct(F.flatten(F.filter(F.array(project["RequiredCommodityClassification"]["ItemClassificationCode"], F.flatten(F.transform(lots, lambda x: x["ProcurementProject"]["RequiredCommodityClassification"]["ItemClassificationCode"]))), lambda x: x.isNotNull())))
    return raw.where("_corrupt is null and id is not null").select(
        F.lit(source).alias("source"),
        F.col("id").alias("external_id"),
        clean(folder["ContractFolderID"]).alias("case_no"),
        clean(folder["LocatedContractingParty"]["Party"]["PartyName"]["Name"]).alias("buyer"),
        clean(F.coalesce(project["Name"], F.col("title"))).alias("title"),
        F.coalesce(lookup(STATES, folder["ContractFolderStatusCode"]), F.lit("desconocido")).alias("state"),
        cpv_codes(F.array_join(codes, " ")).alias("cpv"),
        amount(project["BudgetAmount"]["TaxExclusiveAmount"]).alias("budget"),
        amount(project["BudgetAmount"]["EstimatedOverallContractAmount"]).alias("estimated_value"),
        region_of(project["RealizedLocation"]["CountrySubentityCode"]).alias("region"),
        local_end(end["EndDate"], end["EndTime"]).alias("deadline"),
        F.col("updated"),
        months(project["PlannedPeriod"]["DurationMeasure"]["_VALUE"], project["PlannedPeriod"]["DurationMeasure"]["_unitCode"]).alias("months"),
        F.when(F.size(lots) == 1, F.get(lots, F.lit(0))["ID"]).alias("lot"),
        F.array_join(F.filter(F.transform(lots, lambda x: clean(x["ProcurementProject"]["Name"])), lambda x: x.isNotNull()), " \n").alias("lot_text"),
        clean(result["WinningParty"]["PartyName"]["Name"]).alias("awardee"),
        amount(result["AwardedTenderedProject"]["LegalMonetaryTotal"]["TaxExclusiveAmount"]).alias("award"),
        wall_clock(result["AwardDate"]).alias("awarded_on"),
        F.col("link._href").alias("detail_url"),
        tax_id(folder["LocatedContractingParty"]["Party"]["PartyIdentification"]["ID"]).alias("buyer_id"),
        named(CONTRACT_TYPES, project["TypeCode"]).alias("contract_type"),
        named(PROCEDURES, folder["TenderingProcess"]["ProcedureCode"]).alias("procedure"),
        clean(project["RealizedLocation"]["CountrySubentity"]).alias("place"),
        wall_clock(project["PlannedPeriod"]["StartDate"]).alias("starts_on"),
        wall_clock(project["PlannedPeriod"]["EndDate"]).alias("ends_on"),
        wall_clock(first_published(folder["ValidNoticeInfo"])).alias("published"),
        addresses(*[folder[f"{x}DocumentReference"] for x in ("Legal", "Technical", "Additional")]).alias("documents"),
    )


def eu_state(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.startswith("pin") | k.contains("prior"), "previo").when(k.startswith("can") | k.contains("award") | k.startswith("car"), "adjudicada").when(k.startswith("cn") | k.startswith("subco") | k.contains("competition"), "publicada").otherwise("desconocido")


#: Text, lists and texts by language come alike: such fields are read as JSON text.
EU = """struct<`publication-number`:string,`publication-date`:string,`notice-type`:string,`classification-cpv`:array<string>,`buyer-name`:string,
`notice-title`:string,`description-proc`:string,`description-lot`:string,`deadline-receipt-request`:string,`total-value`:double,
`estimated-value-proc`:string,`duration-period-value-lot`:array<string>,`duration-period-unit-lot`:array<string>,`contract-nature`:string,
`procedure-type`:string,`winner-name`:string,`winner-decision-date`:string,links:struct<html:map<string,string>,pdf:map<string,string>>>"""
#: Fixed value: where the EU service shows a notice.
EU_DETAIL = "https://ted.europa.eu/es/notice/-/detail/"


def longest_duration(values: Column, units: Column) -> Column:
    """Months of the longest lot: values beside their units, the first unit where one is missing, months where there is none."""
    each = F.transform(values, lambda v, k: months(v, F.coalesce(F.get(units, k), F.get(units, F.lit(0)))))
    return F.array_max(F.filter(each, lambda m: m.isNotNull()))


def eu_notices(spark: SparkSession, path: str) -> DataFrame:
    """Notices of the EU service's JSON pages. Dates keep the day as written; notices without a number are left out."""
    return eu_bodies(spark.read.text(path, wholetext=True), "value")


def eu_bodies(pages: DataFrame, body: str = "body") -> DataFrame:
    """The same of pages that a column holds, as a source of pages gives them."""
    parsed = pages.select(F.from_json(body, f"notices array<{EU}>")["notices"].alias("notices"))
    n = parsed.select(F.explode("notices").alias("n")).select("n.*").where(F.col("publication-number").isNotNull() & (F.col("publication-number") != ""))
    text = lambda c: any_language(F.col(c))
    html, pdf = F.col("links.html"), F.col("links.pdf")
    page = F.coalesce(F.element_at(html, F.lit("SPA")), F.element_at(html, F.lit("ENG")), F.get(F.map_values(html), F.lit(0)), F.concat(F.lit(EU_DETAIL), "publication-number"))
    file = F.coalesce(F.element_at(pdf, F.lit("SPA")), F.element_at(pdf, F.lit("ENG")))
    return n.select(
        F.lit("eu").alias("source"),
        F.col("publication-number").alias("external_id"),
        F.col("publication-number").alias("case_no"),
        clean(text("notice-title")).alias("title"),
        clean(F.coalesce(text("description-proc"), text("description-lot"))).alias("summary"),
        clean(text("buyer-name")).alias("buyer"),
        F.array_distinct("classification-cpv").alias("cpv"),
        eu_state(F.col("notice-type")).alias("state"),
        F.col("notice-type").alias("state_code"),
        wall_clock(F.substring_index(F.col("publication-date"), "+", 1)).alias("published"),
        wall_clock(first_of(F.col("deadline-receipt-request"))).alias("deadline"),
        F.col("total-value").alias("budget"),
        amount(first_of(F.col("estimated-value-proc"))).alias("estimated_value"),
        clean(text("winner-name")).alias("awardee"),
        wall_clock(first_of(F.col("winner-decision-date"))).alias("awarded_on"),
        longest_duration(F.col("duration-period-value-lot"), F.col("duration-period-unit-lot")).alias("months"),
        translated(text("contract-nature"), EU_CONTRACT_TYPES).alias("contract_type"),
        translated(text("procedure-type"), EU_PROCEDURES).alias("procedure"),
        page.alias("detail_url"),
        F.filter(F.array(file), lambda x: x.isNotNull()).alias("documents"),
    )


_RANGE = r"(?i)(\d{1,2}[/-]\d{1,2}[/-]\d{4})\s*(?:al|a|fins|hasta|-|–)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})"


def duration_span(text: Column) -> Column:
    """months, starts_on and ends_on of a free text: two dates, else years, else months.

    Two dates in the wrong order, or that are none, tell nothing at all.
    """
    day = lambda k: F.try_to_date(F.nullif(F.translate(F.regexp_extract(text, _RANGE, k), "-", "/"), F.lit("")), "d/M/yyyy")
    a, b = day(1), day(2)
    years = F.regexp_extract(text, r"(?i)(\d{1,2})\s*(?:any|año|anio)", 1).try_cast("double")
    spans = F.regexp_extract(text, r"(?i)(\d{1,3})\s*mes", 1).try_cast("double")
    ranged, ok = text.rlike(_RANGE), F.coalesce(b >= a, F.lit(False))
    length = F.when(ranged, F.when(ok, F.bround(F.datediff(b, a) / 30.44, 2))).otherwise(F.coalesce(years * 12, spans))
    return F.struct(length.alias("months"), F.when(ok, a).alias("starts_on"), F.when(ok, b).alias("ends_on"))


def duration_text(text: Column) -> Column:
    """Months of a free text; null where it tells nothing."""
    return duration_span(text)["months"]

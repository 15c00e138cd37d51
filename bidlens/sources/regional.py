"""Notices of the regional service: JSON rows, one a lot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.scalars import amount, clean, cpv_codes, url, wall_clock
from bidlens.sources.feeds import duration_span

#: States by what a phase contains, in this order.
PHASES = {
    "anunci previ": "previo", "consulta preliminar del mercat": "previo",
    "licitació": "publicada", "licitacio": "publicada", "anunci de licitació": "publicada",
    "avaluació": "evaluacion", "adjudicació": "adjudicada", "formalització": "formalizada",
    "anul·lació": "anulada", "anullació": "anulada", "desistiment": "resuelta", "renúncia": "resuelta",
}
#: States by what a result contains, where the phase tells nothing.
RESULTS = {"adjudic": "adjudicada", "desert": "resuelta", "renúncia": "resuelta", "desistiment": "resuelta"}
#: The fields of a row that are read.
FIELDS = (
    "id_intern", "codi_expedient", "numero_lot", "nom_organ", "codi_dir3", "denominacio", "objecte_contracte", "descripcio_lot",
    "codi_cpv", "codi_nuts", "lloc_execucio", "tipus_contracte", "procediment", "fase_publicacio", "resultat", "nom_ambit",
    "pressupost_licitacio_sense", "pressupost_licitacio_sense_1", "valor_estimat_contracte", "valor_estimat_expedient",
    "data_publicacio_anunci", "data_publicacio_previ", "data_publicacio_contracte", "data_publicacio_adjudicacio",
    "termini_presentacio_ofertes", "data_adjudicacio_contracte", "data_formalitzacio_contracte", "durada_contracte",
    "denominacio_adjudicatari", "import_adjudicacio_sense", "enllac_publicacio", "url_json_licitacio", "url_json_previ", "url_json_adjudicacio",
)
TEXTS = ("objecte_contracte", "denominacio", "descripcio_lot")


def wanted(cpv: Sequence[str] = (), terms: Sequence[str] = (), since: str | None = None) -> Column:
    """Rows with a code that begins so or a text that contains a term (any case, marks count), published since a day.

    Without codes and terms every row is wanted. Plain comparisons, so the JSON scan takes them as pushed filters.
    """
    found = [F.col("codi_cpv").startswith(c) for c in cpv] + [F.upper(t).contains(x.upper()) for x in terms for t in TEXTS]
    either = F.lit(not found)
    for c in found:
        either |= F.coalesce(c, F.lit(False))
    return either & (F.col("data_publicacio_anunci") >= f"{since}T00:00:00") if since else either


def _first(*names: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def state_of(phase: Column, result: Column) -> Column:
    p, r = F.lower(F.trim(phase)), F.lower(F.trim(result))
    of = lambda text, table: F.coalesce(*[F.when(text.contains(k), v) for k, v in table.items()])
    return F.coalesce(of(p, PHASES), of(r, RESULTS), F.lit("desconocido"))


def notices(spark: SparkSession, path: str, cpv: Sequence[str] = (), terms: Sequence[str] = (), since: str | None = None) -> DataFrame:
    """One row per lot. Rows without a number are left out; lot ``0`` is none; where the phase tells no state the result does."""
    raw = spark.read.schema(", ".join(f"{f} string" for f in FIELDS)).option("multiLine", True).json(path).where(wanted(cpv, terms, since))
    lot = F.when(F.col("numero_lot") != "0", F.nullif("numero_lot", F.lit("")))
    name = _first("id_intern", "codi_expedient")
    span = duration_span(F.col("durada_contracte"))
    return raw.where(name.isNotNull()).select(
        F.lit("regional").alias("source"),
        F.concat(name, F.coalesce(F.concat(F.lit("#"), lot), F.lit(""))).alias("external_id"),
        clean(F.col("codi_expedient")).alias("case_no"),
        clean(F.col("nom_organ")).alias("buyer"),
        clean(F.col("codi_dir3")).alias("buyer_id"),
        clean(F.col("denominacio")).alias("title"),
        clean(F.col("objecte_contracte")).alias("summary"),
        cpv_codes(F.col("codi_cpv")).alias("cpv"),
        amount(_first("pressupost_licitacio_sense", "pressupost_licitacio_sense_1")).alias("budget"),
        amount(_first("valor_estimat_contracte", "valor_estimat_expedient")).alias("estimated_value"),
        clean(F.col("procediment")).alias("procedure"),
        clean(F.col("tipus_contracte")).alias("contract_type"),
        state_of(F.col("fase_publicacio"), F.col("resultat")).alias("state"),
        wall_clock(_first("data_publicacio_anunci", "data_publicacio_previ", "data_publicacio_contracte")).alias("published"),
        F.col("termini_presentacio_ofertes").alias("deadline"),
        _first("data_publicacio_adjudicacio", "data_publicacio_anunci").alias("updated"),
        F.lit("Cataluña").alias("region"),
        clean(F.col("lloc_execucio")).alias("place"),
        url(F.col("enllac_publicacio")).alias("detail_url"),
        F.filter(F.array(*[url(F.col(f"url_json_{x}")) for x in ("licitacio", "previ", "adjudicacio")]), lambda x: x.isNotNull()).alias("documents"),
        lot.alias("lot"),
        clean(F.col("descripcio_lot")).alias("lot_text"),
        clean(F.col("denominacio_adjudicatari")).alias("awardee"),
        amount(F.col("import_adjudicacio_sense")).alias("award"),
        wall_clock(F.col("data_adjudicacio_contracte")).alias("awarded_on"),
        span["months"].alias("months"),
        F.coalesce(span["starts_on"], wall_clock(F.col("data_formalitzacio_contracte"))).alias("starts_on"),
        span["ends_on"].alias("ends_on"),
    )

"""Scalar functions of the notice model as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that are dropped from company names, longer ones first.
LEGAL_FORMS = (
    "sociedad cooperativa", "sociedad limitada", "sociedad anonima",
    "s l u", "s l p", "s l l", "s a u", "s a m", "s coop",
    "s l", "s a", "sau", "slu", "sll", "slp", "sa", "sl", "ute", "sme", "mp",
)


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters that are one base letter with marks, and these base letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_folding()), r"\p{Mn}+", "")


def text_norm(c: Column) -> Column:
    """Lower case, without marks, white space collapsed (not trimmed)."""
    return F.regexp_replace(without_marks(F.lower(c)), r"(?U)\s+", " ")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def company_key(name: Column) -> Column:
    """Spellings of one company name meet: no marks, punctuation or legal form. Null if nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(without_marks(F.lower(name)), r"[.,;:()\"']", " "), r"(?U)\s+", " "))
    for form in LEGAL_FORMS:
        t = F.regexp_replace(t, rf"(^|\s){form}(\s|$)", " ")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def amount(text: Column) -> Column:
    """A number as written in Spanish or by a machine: with both separators Spanish, a lone comma is decimal, a lone dot stays."""
    t = F.regexp_replace(text, r"[€\s ]", "")
    both = t.contains(",") & t.contains(".")
    plain = F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.contains(","), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return plain.try_cast("double")


def cpv_codes(text: Column) -> Column:
    """The first run of eight digits of each part, each code once, in order."""
    found = F.transform(F.split(text, r"[;,\s|]+"), lambda x: F.regexp_extract(x, r"\d{8}", 0))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def months(value: Column, unit: Column) -> Column:
    """A duration in months, two decimals; null unless above zero."""
    v, u = value.try_cast("double"), F.upper(F.coalesce(unit, F.lit("")))
    m = F.when(u.startswith("DAY"), v / 30.44).when(u.startswith("ANN") | u.startswith("YEAR"), v * 12).when(u.startswith("WEE"), v / 4.35).otherwise(v)
    return F.when(m > 0, F.bround(m, 2))


_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def iso_instant(text: Column) -> Column:
    """A date and time as ``2024-01-31T10:00:00``, with six digits of a fraction and an offset if the text has them; null if it is none.

    Read are ISO forms, with or without separators, with a time to the hour, minute, second or fraction, and
    ``31/01/2024`` without a time. The clock is never shifted. A day alone is its midnight; a week's day isn't read.
    """
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, _ISO, k)
    padded = lambda k: F.lpad(part(k), 2, "0")
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    spanish = F.try_to_date(F.nullif(F.regexp_extract(t, slashed, 0), F.lit("")), "d/M/yyyy")
    day = F.try_to_date(F.nullif(F.concat(part(1), part(2), part(3)), F.lit("")), "yyyyMMdd")
    clock = F.concat_ws(":", padded(4), padded(5), padded(6))
    sound = (padded(4) < "24") & (padded(5) < "60") & (padded(6) < "60")
    fraction = F.rpad(part(7), 6, "0")
    zone = F.when(part(8) == "Z", "+00:00").when(part(8) == "", "").otherwise(F.concat(F.substring(part(8), 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(part(8), 4, 3), ":", ""), 2, "0")))
    made = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.when(part(7).rlike("[1-9]"), F.concat(F.lit("."), fraction)).otherwise(""), zone)
    return F.when(spanish.isNotNull(), F.concat(F.date_format(spanish, "yyyy-MM-dd"), F.lit("T00:00:00"))).when(sound, made)


def wall_clock(text: Column) -> Column:
    """The day of :func:`iso_instant`: as written, never shifted by an offset; null if it is none."""
    return F.to_date(F.substring(iso_instant(text), 1, 10))


def useful_title(title: Column) -> Column:
    """What is left of ``country - kind - title``: from the third part on, or the second of two."""
    parts = F.split(title, r"\s+[-–—]\s+")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 1000), " - ")).when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(title)


def group_key(buyer: Column, case_no: Column, title: Column, eu: Column, source: Column, external_id: Column) -> Column:
    """Buyer and case number (or title) without all but letters and digits; the notice's own name if there is neither."""
    alnum = lambda c, n: F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", ""), 1, n)
    anchor = F.when(eu, alnum(useful_title(title), 80)).otherwise(F.coalesce(F.nullif(alnum(case_no, 1000), F.lit("")), alnum(title, 40)))
    return F.when(anchor == "", F.concat_ws(":", source, external_id)).otherwise(F.concat(alnum(buyer, 40), F.lit("|"), anchor))


def window_end(as_of: Column, n: int) -> Column:
    """The day after ``as_of`` plus ``n`` months, where a day that the month lacks runs over into the next month."""
    return F.date_add(F.add_months(F.trunc(as_of, "MM"), n), F.dayofmonth(as_of))


def stem(text: Column, term: str) -> Column:
    """Whether a word of the normalised text begins with ``term``; a space at its end asks for the whole word."""
    import re

    end = r"(?![\p{L}\p{N}_])" if term.endswith(" ") else ""
    return text.contains(term.strip()) & text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term.strip())}{end}")


#: Names of CPV divisions; others are ``otros``.
CPV_DIVISIONS = {
    "72": "servicios de TI", "48": "paquetes de software", "79": "servicios para empresas y seguridad", "80": "enseñanza y formación",
    "30": "equipos de oficina e informática", "32": "equipos de telecomunicaciones", "50": "reparación y mantenimiento",
    "64": "servicios de telecomunicaciones", "71": "arquitectura e ingeniería", "35": "seguridad y defensa", "51": "servicios de instalación",
    "75": "administración pública", "98": "otros servicios",
}


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def cpv_division(code: Column) -> Column:
    return F.coalesce(F.element_at(_mapped(CPV_DIVISIONS), F.substring(code, 1, 2)), F.lit("otros"))


def any_language(text: Column, preferred: tuple[str, ...] = ("spa", "eng"), by: str = " · ") -> Column:
    """The text of a JSON value: a text itself, the different texts of a list joined, of texts by language the first preferred one that isn't empty, else the first."""
    kept = lambda x: F.filter(x, lambda v: v.isNotNull() & (v != ""))
    flat = lambda v: F.nullif(F.when(v.startswith("["), F.array_join(F.array_distinct(kept(F.from_json(v, "array<string>"))), by)).otherwise(v), F.lit(""))
    of = F.from_json(text, "map<string,string>")
    first = F.get(kept(F.transform(F.map_values(of), flat)), F.lit(0))
    return F.when(text.startswith("{"), F.coalesce(*[flat(F.element_at(of, F.lit(x))) for x in preferred], first)).otherwise(flat(text))


def first_of(text: Column) -> Column:
    """The first of a JSON list, or the value itself."""
    return F.when(text.startswith("["), F.get(F.from_json(text, "array<string>"), F.lit(0))).otherwise(text)


def translated(joined: Column, table: dict[str, str], by: str = " · ") -> Column:
    """Each part of a joined text by ``table`` (itself where it isn't there), once, in order; null if empty."""
    parts = F.transform(F.split(joined, by), lambda x: F.coalesce(F.element_at(_mapped(table), F.trim(x)), F.trim(x)))
    return F.nullif(F.array_join(F.array_distinct(parts), by), F.lit(""))


def tax_id(ids: Column) -> Column:
    """The first of ``ids`` that has the form of a tax id, in capitals."""
    return F.get(F.filter(F.transform(ids, F.upper), lambda x: x.rlike(r"^([A-Z]\d{8}|\d{8}[A-Z]|[A-Z]\d{7}[A-Z0-9])$")), F.lit(0))


def url(text: Column) -> Column:
    """The address of a JSON object's ``url``, or of a text that is one."""
    return F.coalesce(F.get_json_object(text, "$.url"), F.when(text.startswith("http"), text))


def version_parts(version: Column) -> Column:
    """``v1.10`` as (1, 10), which sort as versions do; a part without digits is 0."""
    return F.transform(F.split(F.regexp_replace(F.trim(version), "^[vV]+", ""), r"\."), lambda x: F.coalesce(F.regexp_replace(x, r"\D", "").try_cast("long"), F.lit(0)))


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the named columns as JSON, in order of names, nulls included: what tells whether a notice is a new version."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def clamped(value: int, least: int, most: int) -> int:
    """A parameter within its range: months 1 to 60, rows 1 to 200."""
    return max(least, min(most, value))

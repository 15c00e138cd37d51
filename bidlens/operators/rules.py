"""Profiles: saved rule sets, compiled to columns. No function per row, no product of notices and profiles."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.fence import fenced
from bidlens.functions.scalars import stem, text_norm

LARGE_AMOUNT = 100_000
ENGINE = "1"


@dataclass(frozen=True)
class Profile:
    name: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    cpv: tuple[str, ...] = ()
    min_amount: float = 0
    regions: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    active: bool = True
    query_terms: tuple[str, ...] = field(default=(), compare=False)


def load(text: str) -> list[Profile]:
    """Profiles of a JSON list, or of ``profiles`` in an object; unknown keys are refused."""
    raw = json.loads(text)
    known = {f.name for f in fields(Profile)}
    out = []
    for x in raw if isinstance(raw, list) else raw["profiles"]:
        if unknown := set(x) - known:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        out.append(Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}))
    check(out)
    return out


def check(profiles: Sequence[Profile]) -> None:
    names = [p.name.strip() for p in profiles]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("profiles need names, each its own")
    if not any(p.active for p in profiles):
        raise ValueError("no profile is active")
    for p in profiles:
        if not p.strong and not p.weak:
            raise ValueError(f"{p.name}: no terms")
        if p.weak and not p.context:
            raise ValueError(f"{p.name}: weak terms need a context")
        if any(not t.strip() for t in (*p.strong, *p.weak, *p.context, *p.exclude)):
            raise ValueError(f"{p.name}: empty term")


def warnings(p: Profile) -> list[str]:
    """Terms of three letters or fewer that aren't whole words."""
    return [t for t in (*p.strong, *p.weak, *p.context, *p.exclude) if len(t.strip()) <= 3 and not t.endswith(" ")]


def fingerprint(profiles: Sequence[Profile]) -> str:
    """Changes with anything that changes an evaluation; terms of remote queries don't."""
    rows = [{k: v for k, v in asdict(p).items() if k != "query_terms"} for p in profiles if p.active]
    return hashlib.sha256(json.dumps([ENGINE, rows]).encode()).hexdigest()[:32]


def query_terms(profiles: Sequence[Profile], least: int = 4) -> list[str]:
    """Terms for remote searches: those given, else the strong ones, of ``least`` letters and more; each once, in order."""
    return list(dict.fromkeys(t.strip() for p in profiles if p.active for t in (p.query_terms or p.strong) if len(t.strip()) >= least))


def cpv_prefix(code: str) -> str:
    digits = re.sub(r"\D", "", code)
    return digits.rstrip("0").ljust(2, "0") if len(digits) >= 2 else digits


def _hits(terms: Sequence[str], text: Column) -> Column:
    """The terms that the text has, in declared order."""
    found = [F.when(stem(text, t), F.lit(t)) for t in terms]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def _any(terms: Sequence[str], text: Column) -> Column:
    out = F.lit(False)
    for t in terms:
        out |= stem(text, t)
    return out


def _parts(p: Profile, k: int, t: Column, cpv: Column) -> dict[str, Column]:
    """What a verdict under ``p`` looks at, as columns with the number ``k`` in their names."""
    sieve = F.lit(False)
    for term in (*p.strong, *p.weak):
        sieve |= t.contains(term.strip())
    prefixes = F.array(*[F.lit(cpv_prefix(c)) for c in p.cpv]) if p.cpv else F.array().cast("array<string>")
    coded = F.filter(cpv, lambda c: F.exists(prefixes, lambda x: c.startswith(x)))
    hits = {name: F.when(sieve, _hits(terms, t)) for name, terms in (("strong", p.strong), ("weak", p.weak), ("context", p.context))}
    return {f"_{name}{k}": c for name, c in (hits | {"coded": coded, "excluded": sieve & _any(p.exclude, t)}).items()}


def _judged(p: Profile, k: int, region: Column, amount: Column, source: Column) -> tuple[Column, Column, Column]:
    """Verdict, score and reason from the columns of :func:`_parts`."""
    at = lambda name: F.col(f"_{name}{k}")
    s, w, c = F.size(at("strong")), F.size(at("weak")), F.size(at("context"))
    scoped = F.exists(F.array(*map(F.lit, p.sources)), lambda x: F.coalesce(source, F.lit("")).startswith(x)) if p.sources else F.lit(True)
    verdict = F.when(~scoped, "source").when(at("strong").isNull() | (s + w == 0), "no term").when(at("excluded"), "excluded")
    if p.regions:
        verdict = verdict.when(region.isNotNull() & ~region.isin(*p.regions), "region")
    verdict = verdict.when(amount < p.min_amount, "amount").when(s > 0, "accepted").when(c > 0, "accepted").otherwise("weak only")
    both, coded, large = (w > 0) & (c > 0), F.size(at("coded")) > 0, F.coalesce(amount >= LARGE_AMOUNT, F.lit(False))
    score = F.when(s > 0, 3.0 + 0.5 * (s - 1)).otherwise(0.0) + F.when(both, 2.0).otherwise(0.0) + F.when(coded, 1.0).otherwise(0.0) + F.when(large, 0.5).otherwise(0.0)
    part = lambda name, ok: F.when(ok, F.concat(F.lit(f"{'cpv' if name == 'coded' else name}: "), F.array_join(F.slice(at(name), 1, 3), ", ")))
    reason = F.concat_ws("; ", part("strong", s > 0), part("weak", both), part("context", both), part("coded", coded), F.when(large, "large amount"))
    return verdict, score, reason


def evaluate(rows: DataFrame, p: Profile, text: str = "text_norm", region: str = "region", amount: str = "amount", source: str = "source", cpv: str = "cpv") -> DataFrame:
    """``rows`` with verdict, score and reason under ``p``. ``text`` is normalised already.

    In order: source (by prefix; an unknown one is in no scope), any term at all, exclusion, region (unknown passes), least
    amount (unknown passes), terms. Strong terms accept, weak ones with a context; a CPV code adds to the score but never
    accepts alone.
    """
    one = fenced(rows, _parts(p, 0, F.col(text), F.col(cpv)))
    verdict, score, reason = _judged(p, 0, F.col(region), F.col(amount), F.col(source))
    two = one.withColumn("verdict", verdict)
    accepted = F.col("verdict") == "accepted"
    return fenced(two, {"verdict": F.col("verdict"), "score": F.when(accepted, score), "reason": F.when(accepted, reason)}).select(*[c for c in rows.columns if c not in ("verdict", "score", "reason")], "verdict", "score", "reason")


def matches(rows: DataFrame, profiles: Sequence[Profile], key: str, text: str = "text_norm", region: str = "region", amount: str = "amount", source: str = "source", cpv: str = "cpv") -> DataFrame:
    """key, profile, score and reason of each acceptance under an active profile. The rows are read once for all profiles."""
    active = [p for p in profiles if p.active]
    if not active:
        raise ValueError("no profile is active")
    narrow = rows.select(key, *dict.fromkeys((text, region, amount, source, cpv)))
    found = fenced(narrow, {c: x for k, p in enumerate(active) for c, x in _parts(p, k, F.col(text), F.col(cpv)).items()})
    accepted = []
    for k, p in enumerate(active):
        verdict, score, reason = _judged(p, k, F.col(region), F.col(amount), F.col(source))
        accepted.append(F.when(verdict == "accepted", F.struct(F.lit(p.name).alias("profile"), score.alias("score"), reason.alias("reason"))))
    return found.select(key, F.inline(F.filter(F.array(*accepted), lambda x: x.isNotNull())))


def reevaluate(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, profile, change (created, updated, removed, same), score and reason of each pair that is stored or holds now.

    A stored pair of a profile that isn't active any more has no match now, so it is removed.
    """
    old = stored.select(key, "profile", F.col("score").alias("_score"), F.col("reason").alias("_reason"), F.lit(True).alias("_was"))
    both = now.select(key, "profile", "score", "reason", F.lit(True).alias("_is")).join(old, [key, "profile"], "full")
    same = F.col("score").eqNullSafe(F.col("_score")) & F.col("reason").eqNullSafe(F.col("_reason"))
    change = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "removed").when(same, "same").otherwise("updated")
    return both.select(key, "profile", change.alias("change"), "score", "reason")


def outcome(changes: DataFrame) -> DataFrame:
    """Per profile how many pairs a run creates, updates and removes."""
    n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return changes.groupBy("profile").agg(n("created"), n("updated"), n("removed"))


def orphans(stored: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Stored matches of profiles that are gone, renamed or inactive."""
    return stored.where(~F.col("profile").isin(*[p.name for p in profiles if p.active]))


def preview(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Matches that would come and go: key, profile and change (enter or leave). Nothing is written."""
    on = [key, "profile"]
    return after.select(*on).exceptAll(before.select(*on)).withColumn("change", F.lit("enter")).unionByName(before.select(*on).exceptAll(after.select(*on)).withColumn("change", F.lit("leave")))


def documents_as_notices(docs: DataFrame) -> DataFrame:
    """Documents in the shape that rules read; ``src0`` stands for a source that is unknown."""
    cpv = F.array(F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("100000")))
    rows = docs.select("doc_id", "text", F.col("lang").alias("region"), F.nullif("source", F.lit("src0")).alias("source"), F.col("n_chars").cast("double").alias("amount"), cpv.alias("cpv"))
    return fenced(rows, {"text_norm": text_norm(F.col("text"))}).drop("text")

"""Secret scans with DataFrame functions alone.

Base kinds are patterns. Beyond them, runs of token characters are candidates: a window slides over each and its
Shannon entropy is kept from counts, one character entering and one leaving at a step. What is above the limit of its
character class is reported, unless the allow-list knows it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.text import blocks_of, free_parts, packed, piece, running_sums, unpacked, whole

#: Patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A shorter value fails; the pattern has taken it all the same, so this can't be part of it. In the other two, a run
#: that is too short has no longer part, so it can.
LEAST_ASSIGNED = 12

#: Candidates: runs of characters that tokens are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Strings that are known not to be secrets, whatever their entropy.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem",
    r"(?i)abcdefgh|qwerty|0123456789|1234567890",
    r"^[A-Za-z/_=-]+$",
    r"^[0-9/_=-]+$",
)


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidates: which ones it takes, its characters, and the entropy (bits a character) that it allows."""

    name: str
    pattern: str
    characters: str
    limit: float


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A candidate belongs to the first class that takes it. 20 random hex digits have 3.2 bits, 20 random base64 characters 4.1.
CLASSES = (
    CharacterClass("entropy_hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    CharacterClass("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789" + UPPER.lower() + UPPER + "+/_=-", 3.8),
)


def _places(docs: DataFrame, name: str, pattern: str) -> DataFrame:
    """``docs`` with ``name``: the leftmost non-overlapping matches in ``_t`` as structs of s, start, end (code points).

    Matches and what lies between them alternate, so lengths give places. The text is split only where there is a match.
    Lists are walked side by side, none by place, so the time grows with the text alone.
    """
    found = docs.withColumn("_m", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    cut = found.withColumn("_gap", F.when(F.size("_m") > 0, F.transform(F.split("_t", pattern, -1), lambda x: F.length(x).cast("long"))))
    # before match k are the gaps up to it and the matches before it
    before = running_sums(F.zip_with("_m", F.slice("_gap", 1, F.size("_m")), lambda x, g: F.length(x) + g))
    sums = cut.withColumn("_start", F.when(F.size("_m") > 0, F.zip_with(before, F.slice("_gap", 1, F.size("_m")), lambda s, g: s + g)))
    spans = F.zip_with("_m", "_start", lambda x, at: F.struct(x.alias("s"), at.alias("start"), (at + F.length(x)).alias("end")))
    return sums.withColumn(name, F.when(F.size("_m") > 0, spans).otherwise(F.array().cast("array<struct<s:string,start:bigint,end:bigint>>"))).drop("_m", "_gap", "_start")


#: Entropies are compared as whole numbers, so that no error adds up along a run.
SCALE = 1 << 40


def _x_log_x(n: int) -> int:
    return round(n * math.log2(n) * SCALE) if n else 0


def highest_window(s: Column, characters: str, limit: float, window: int = WINDOW) -> Column:
    """From the windows over ``s`` (characters of the class only): best entropy, start of the first and end of the last above the limit.

    The state has the count of each character and the sum of count * log2(count). A step takes the new character in
    and puts the one that leaves out, and moves the sum by what these two counts give. Counts are characters of one
    string, "0" for none. What a step has made is judged by the next, so that it is computed once.
    """
    if window > 60:
        raise ValueError("a window may have 60 characters at most")
    # what the sum gains when a count grows from k
    rise = F.array(*[F.lit(_x_log_x(k + 1) - _x_log_x(k)).cast("long") for k in range(window + 1)])
    most = math.floor((math.log2(window) - limit) * window * SCALE)
    places = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(characters), c))
    left = lambda x: F.slice(F.concat(F.array_repeat(F.lit(0), window), x), 1, F.size(x))
    pairs = F.flatten(F.transform(F.array(places), lambda x: F.arrays_zip(x.alias("new"), left(x).alias("old"))))
    zero = F.struct(
        F.lit("0" * len(characters)).alias("n"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("i"),
        F.lit(1 << 62).cast("long").alias("least"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    count = lambda n, c: F.ascii(F.substring(n, c, F.lit(1))) - 48
    put = lambda n, c, by: F.overlay(n, F.char((count(n, c) + 48 + by).cast("long")), c, F.lit(1))

    def judged(a: Column) -> list[Column]:
        full = a["i"] >= window
        above = full & (a["sum"] <= most)
        return [
            F.when(full, F.least(a["least"], a["sum"])).otherwise(a["least"]).alias("least"),
            F.coalesce(a["first"], F.when(above, a["i"] - window)).alias("first"),
            F.when(above, a["i"]).otherwise(a["last"]).alias("last"),
        ]

    def step(a: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        gone = F.when(old > 0, F.element_at(rise, count(a["n"], old))).otherwise(F.lit(0).cast("long"))
        moved = F.when(new == old, F.lit(0).cast("long")).otherwise(F.element_at(rise, count(a["n"], new) + 1) - gone)
        swapped = F.when(old > 0, put(put(a["n"], new, 1), old, -1)).otherwise(put(a["n"], new, 1))
        return F.struct(F.when(new == old, a["n"]).otherwise(swapped).alias("n"), (a["sum"] + moved).alias("sum"), (a["i"] + 1).alias("i"), *judged(a))

    def result(a: Column) -> Column:
        least, first, last = judged(a)
        best = F.when(a["i"] < window, F.lit(-1.0)).otherwise(F.lit(math.log2(window)) - least / F.lit(float(SCALE * window)))
        return F.struct(best.alias("best"), first.alias("first"), last.alias("last"))

    return F.aggregate(pairs, zero, step, result)


def find(docs: DataFrame, text: str = "text", window: int = WINDOW, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with a column ``spans``: array of kind, start, end (code points, end exclusive), by start and kind.

    Base spans always stay, and are cut out of the candidates. What is left of a candidate, a window or more long, that no
    pattern of ``allowed`` knows adds the part from its first to its last window above the limit of its class. Null and
    empty texts have no spans. All is done in the row, in time that grows with the text, however long a candidate and
    however many there are; rows repeat, and other columns pass, as they are; a column ``spans`` is replaced.
    """
    rest = [c for c in docs.columns if c != "spans"]
    rows = docs.select(packed(docs, rest), whole(text).alias("_t"))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_run", CANDIDATE)):
        rows = _places(rows, name, pattern)
    kind = lambda c, k, rank: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(k).alias("kind"), x["end"].alias("end")))
    strong = F.filter("_assign", lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    rows = rows.withColumn("_base", F.concat(kind(strong, "assign", 0), kind(F.col("_access"), "access", 1), kind(F.col("_hex"), "hex", 2)))
    event = lambda taken: lambda x: F.struct(x["start"].alias("start"), (~F.lit(taken)).alias("run"), x["end"].alias("end"), F.lit(taken).alias("taken"))
    events = F.sort_array(F.concat(F.transform("_base", event(True)), F.transform("_run", event(False))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = rows.withColumn("_part", F.when(F.size("_run") > 0, free_parts(events, window)).otherwise(none))
    blocks = F.when(F.size("_part") > 0, blocks_of(F.col("_t")))
    # one row in, one row out: nothing that stands in a list's function below is computed again for each element
    rows = rows.select("_row", "_base", "_part", blocks.alias("_blocks")).select("_row", F.inline(F.array(F.struct("_base", "_part", "_blocks"))))
    known = lambda s: _any([s.rlike(p) for p in allowed])
    parts = F.transform("_part", lambda p: F.struct(piece(F.col("_blocks"), p["start"], p["end"]).alias("s"), p["start"].alias("start")))
    rows = rows.withColumn("_free", F.when(F.size("_part") > 0, F.filter(parts, lambda r: ~known(r["s"]))).otherwise(F.array().cast("array<struct<s:string,start:bigint>>")))
    for k, c in enumerate(classes):
        rows = rows.withColumn(f"_scored{k}", F.when(F.size("_free") > 0, _scored(c, classes[:k], window)))
    every = F.sort_array(F.concat("_base", *[_added(f"_scored{k}", 3 + k, c.name) for k, c in enumerate(classes)]))
    spans = F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # Filters on the spans stay above this: pushed into the steps, they would compute each step once for each use.
    return rows.select("_row", F.struct(spans.alias("spans")).alias("_found")).select(*unpacked(rest), F.inline(F.array("_found")))


def _scored(c: CharacterClass, before: tuple[CharacterClass, ...], window: int) -> Column:
    """The free candidates of class ``c``, that those ``before`` don't take, with their windows."""
    mine = F.filter("_free", lambda r: r["s"].rlike(c.pattern) & ~_any([r["s"].rlike(o.pattern) for o in before]))
    return F.transform(mine, lambda r: F.struct(r["start"].alias("start"), highest_window(r["s"], c.characters, c.limit, window).alias("w")))


def _added(scored: str, rank: int, kind: str) -> Column:
    """Spans of the candidates that have a window above the limit."""
    hit = F.filter(scored, lambda r: r["w"]["last"].isNotNull())
    spans = F.transform(hit, lambda r: F.struct((r["start"] + r["w"]["first"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (r["start"] + r["w"]["last"]).alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def listed(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of the text replaced by ``mark`` (spans that overlap or touch by one); columns as before.

    Null and empty texts stay as they are, repeated rows repeat, and long texts cost time in proportion to their length.
    """
    found = find(docs.select(packed(docs), F.col(text).alias("_text")), "_text")
    taken = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.lit(False).alias("run"), x["end"].alias("end"), F.lit(True).alias("taken")))
    all_of = F.struct(F.lit(0).cast("long").alias("start"), F.lit(True).alias("run"), F.length("_text").cast("long").alias("end"), F.lit(False).alias("taken"))
    gaps = F.when(F.size("spans") > 0, free_parts(F.concat(F.array(all_of), taken), 1))
    cut = found.select("_row", "_text", "spans", gaps.alias("_gap"), F.when(F.size("spans") > 0, blocks_of(F.col("_text"))).alias("_blocks"))
    cut = cut.select("_row", F.inline(F.array(F.struct("_text", "spans", "_gap", "_blocks"))))
    left = F.array_join(F.transform("_gap", lambda g: piece(F.col("_blocks"), g["start"], g["end"])), mark)
    # a mark stands between gaps; at an end of the text that a span has, one is added
    head = F.when(F.array_min("spans.start") == 0, F.lit(mark)).otherwise(F.lit(""))
    tail = F.when(F.array_max("spans.end") == F.length("_text"), F.lit(mark)).otherwise(F.lit(""))
    marked = F.when(F.size("_gap") == 0, F.lit(mark)).otherwise(F.concat(head, left, tail))
    clean = F.when(F.size("spans") == 0, F.col("_text")).otherwise(marked)
    return cut.select(*[clean.alias(text) if c == text else old for c, old in zip(docs.columns, unpacked(docs.columns), strict=True)])


BASE = ("assign", "access", "hex")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed("spans", BASE), 256).alias("base_sha256"), listed("spans").alias("spans"))

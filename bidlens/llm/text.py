"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The rows as one struct ``_row``, so that their names can't clash with those of an operator's own columns."""
    names = docs.columns if columns is None else columns
    return (F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0))).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in columns]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array for a text without any."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def count_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kinds: tuple[str, str], block: int = 512) -> Column:
    """``emit(state, x)`` for each element x of the array, in order, with the state that ``step`` makes of those before x.

    ``kinds`` are the types of the state and of what is emitted. Spark copies a fold's state at each step, so lists in
    it stay short: blocks are folded for the states at their starts, then each block for its own list.
    """
    state, out = kinds
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    pieces = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))

    def both(parts: Column) -> Column:
        zero_of = F.struct(empty(state).alias("out"), zero.cast(state).alias("now"))
        starts = F.aggregate(parts, zero_of, lambda a, p: F.struct(F.concat(a["out"], F.array(a["now"])).alias("out"), F.aggregate(p, a["now"], step).alias("now")), lambda a: a["out"])
        each = lambda p, s: F.aggregate(p, F.struct(empty(out).alias("out"), s.alias("now")), lambda a, x: F.struct(F.concat(a["out"], F.array(emit(a["now"], x))).alias("out"), step(a["now"], x).alias("now")), lambda a: a["out"])
        return F.flatten(F.zip_with(parts, starts, each))

    return F.when(F.size(values) == 0, empty(out)).otherwise(_bound(_bound(values, pieces), both))


def running_sums(values: Column) -> Column:
    """For each element of the array the sum of those before it."""
    return scanned(values, F.lit(0), lambda s, x: s + x.cast("long"), lambda s, x: s, ("bigint", "bigint"))


def free_parts(events: Column, window: int) -> Column:
    """What taken spans leave of runs: parts (start, end) of ``window`` or more, in order.

    ``events`` are structs of start, end and taken (boolean), by start. Runs don't overlap each other; taken spans may.
    """
    state = "struct<at:bigint,stop:bigint,cover:bigint>"

    def step(a: Column, x: Column) -> Column:
        return F.struct(
            F.when(x["taken"], F.greatest(a["at"], x["end"])).otherwise(F.greatest(x["start"], a["cover"])).alias("at"),
            F.when(x["taken"], a["stop"]).otherwise(x["end"]).alias("stop"),
            F.when(x["taken"], F.greatest(a["cover"], x["end"])).otherwise(a["cover"]).alias("cover"),
        )

    # each event ends a part: where it starts, or where the run before it has ended
    part = lambda a, x: F.struct(a["at"].alias("start"), F.least(x["start"], a["stop"]).alias("end"))
    far = F.lit(1 << 62).cast("long")
    last = F.struct(far.alias("start"), F.lit(True).alias("run"), far.alias("end"), F.lit(False).alias("taken"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("at", "stop", "cover")])
    parts = scanned(F.concat(events, F.array(last)), zero, step, part, (state, "struct<start:bigint,end:bigint>"))
    return F.filter(parts, lambda p: p["end"] - p["start"] >= window)


#: Code points in a block of a text that pieces are cut from.
BLOCK = 4096


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text between two places; only the blocks that it touches are read, so many pieces of a long text are cheap."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(blocks, first + 1, n), ""), (start - F.lit(BLOCK).cast("long") * first + 1).cast("int"), (end - start).cast("int"))

"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import written
from bidlens.llm.text import count_words, packed, unpacked, whole
from bidlens.session import prepare

WEIGHTS = (5, 2, 1)
#: The mix is so many times the size of all sources, in parts of this many.
TOTAL, TOTAL_OF = 3, 2
MOST_REPEATS = 2
SEED = "mix-1"
#: Seeds of a source's draws that are tried; the one whose words come nearest to the target is taken.
SEEDS = 8
#: The plan by source is broadcast up to this many sources and bytes of their names, and joined by a shuffle beyond it.
BROADCAST_SOURCES, BROADCAST_BYTES = 200_000, 16_000_000


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size and what else they have), and the target of each.

    Sources in code-point order, null last, weigh as ``weights`` say, again and again. A target stops at
    ``MOST_REPEATS`` times the source's size; what is above goes to the others by weight, until none is above.
    All targets below their stop are one level times the weight, so each round needs three sums over the sources;
    nothing but these sums comes to the driver.
    """
    spark = prepare(sources.sparkSession)
    ordered = sources.orderBy(F.col("source").isNull(), "source")
    schema = T.StructType([*sources.schema, T.StructField("at", T.LongType())])
    numbered = spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    table = numbered.withColumn("weight", weight).checkpoint()
    size = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long")).first()[0]
    stop = MOST_REPEATS * F.col("source_size")
    level, before = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > stop
        stopped, held, open_weight = table.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, stop)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if stopped == before or not open_weight:
            break
        before, level = stopped, (TOTAL * size / TOTAL_OF - held) / open_weight
    target = F.least(F.col("weight") * F.lit(float(level)), stop.cast("double"))
    return table.select(*sources.columns, target.alias("target"))


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the hash of ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _name(doc_id: str, text: str) -> Column:
    """What a document's draws are seeded by: the id; for a null id, the text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.encode(whole(text), "UTF-8"))))


def _copies(rate: str, name: str, seed: Column) -> Column:
    again = _uniform(F.concat(seed, F.lit(":"), F.col(name))) < F.col(rate) - F.floor(rate)
    return (F.floor(rate) + again.cast("long")).cast("long")


def _small(plan: DataFrame) -> bool:
    n, size = plan.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES


def _with_plan(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """``rows``, which have a column ``of``, with what the plan has for their source. Only the plan is moved while that is small."""
    own = plan.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(own) if small else own, rows["of"].eqNullSafe(own["_source"])).drop("_source")


def plan_of(sized: DataFrame, seed: str = SEED) -> tuple[DataFrame, bool]:
    """A row per source: source, source_size, target, rate and seed; and whether that is small. ``sized`` has of (the source), name and size.

    Of ``SEEDS`` seeds a source takes the one whose draws come nearest to its target, the first of equals. So small
    sources and those with a few very large documents come near, too, and each document still has its own draw.
    """
    goal = targets(sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").cast("long").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", rate).checkpoint()
    small = _small(goal)
    names = [f"{seed}-{k}" for k in range(SEEDS)]
    tried = _with_plan(sized, goal, small).groupBy("of").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * _copies("rate", "name", F.lit(s))).alias(s) for s in names])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"`{s}`") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k, s in enumerate(names)]))["k"]
    chosen = tried.select("of", F.element_at(F.array(*map(F.lit, names)), best + 1).alias("seed"))
    return _with_plan(chosen, goal, small).withColumnRenamed("of", "source").checkpoint(), small


def rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target and copies.

    copies: floor(rate) with rate = target / source_size, and one more with the fraction as its probability, drawn by a
    hash of the source's seed and the id, so that reruns agree.
    Null or empty texts have size 0; a source of size 0 has target 0 and no copies. A null source is a source, a null id
    draws by its text. Repeated rows are documents of their own, with the same draw.
    """
    sized = written(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("of"), _name(doc_id, text).alias("name"), count_words(whole(text)).alias("size")), "sized")
    drawn = _with_plan(sized, *plan_of(sized, seed))
    return drawn.select(F.col("id").alias(doc_id), "size", "source_size", "target", _copies("rate", "name", F.col("seed")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``docs``, each row as often as the mix takes it; columns as before. Documents that it takes no copy of are not there.

    Nulls, empty texts and repeated rows as in :func:`rates`; rows are emitted where they are read.
    """
    sized = written(docs.select(F.col(source).alias("of"), _name(doc_id, text).alias("name"), count_words(whole(text)).alias("size")), "sized")
    wide = docs.select(packed(docs), _name(doc_id, text).alias("name"), F.col(source).alias("of"))
    drawn = _with_plan(wide, *plan_of(sized, seed))
    return drawn.select("_row", F.explode(F.array_repeat(F.lit(0), _copies("rate", "name", F.col("seed")).cast("int")))).select(*unpacked(docs.columns))


def op4_rows(docs: DataFrame) -> DataFrame:
    mixed = rates(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return op4_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


#: f(level) = sum of least(weight * level, stop) is the least of the lines that the sources, ordered by where they
#: stop, make; so the level that meets the total is the largest of those of the lines.
OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
lines AS (
  SELECT (3 * sum(source_size) OVER () / 2 - coalesce(sum(2 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source_size, encode(coalesce(source, '')), source IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(weight * level, 2.0 * source_size)::DOUBLE AS target FROM sources, (SELECT max(level)::DOUBLE AS level FROM lines)),
joined AS (
  SELECT doc_id, size, source_size, target, plan.source, name, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source),
drawn AS (
  SELECT *, (size * (floor(rate) + (('0x' || substr(md5('mix-1-' || k || ':' || name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT))::BIGINT AS taken
  FROM joined, range(8) AS seeds(k)),
chosen AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(words - target), k) AS place
  FROM (SELECT source, k, sum(taken) AS words, any_value(target) AS target FROM drawn GROUP BY source, k))
SELECT doc_id, size, source_size, target, taken
FROM drawn JOIN chosen ON drawn.source IS NOT DISTINCT FROM chosen.source AND drawn.k = chosen.k
WHERE place = 1
"""

"""Quality rules: per-document counts, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.text import SPACE_CHARS, count_chars, packed, unpacked, whole, words_of
from bidlens.session import prepare

#: A line that more documents of one host have than both limits, a number and a share of the host's documents, is boilerplate there.
MAX_DOCS_PER_HOST, MAX_SHARE_OF_HOST = 50, 0.1
#: A document that keeps a smaller share of its words is depleted.
MIN_SHARE_LEFT = 0.2
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: The frequent lines are broadcast up to this many (24 bytes each), and joined by a shuffle beyond it.
BROADCAST_LINES = 200_000


def _repeat_words(words: str, hashes: str) -> Column:
    """Words in windows whose hash occurs twice or more; the costly way is taken only where there are any."""
    h = F.col(hashes)
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when((F.size(h) == 0) | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(None)).otherwise(ordered)


def text_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long.

    Null texts count as empty. All is computed in the row, without a shuffle.
    """
    keep = docs.columns
    one = docs.withColumn("_t", whole(text)).withColumn("_words", words_of(F.col("_t")))
    w = F.col("_words")
    last = F.size(w) - (window - 1)
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    two = one.withColumns(
        {
            "_n": F.size(w).cast("long"),
            "_h": F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, window)))),
            "_lines": lines,
        }
    ).drop("_words")
    three = two.withColumn("_s", _repeat_words("_words", "_h"))
    s = F.col("_s")
    found = F.array_sort(
        F.filter(
            F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda x: x.isNotNull(),
        )
    )
    four = three.withColumn("_p", found)
    p = F.col("_p")
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000_000).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    five = four.select(
        *keep,
        F.struct(
            F.col("_n").alias("n_words"),
            F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
            count_chars(F.col("_t"), SYMBOLS).alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ).alias("_counts"),
    )
    # Filters on the counts stay above this: pushed into the steps, they would compute each step once for each use.
    return five.select(*keep, F.inline(F.array("_counts")))


def _host(host: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull())


def _document(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id; for a null id, the text."""
    return F.xxhash64(doc_id, F.when(doc_id.isNull(), text))


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """A row for each line that has a word: id, hash of the text, document, host, key (host and normalised line hashed), its place and words.

    Normalised: lower case, runs of white space as one space, trimmed.
    """
    tidy = F.regexp_replace(F.lower(whole(text)), r"[\x20\x09\x0B-\x0D]+", " ")
    told = (F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("body"), _document(F.col(doc_id), whole(text)).alias("doc"), _host(F.col(host)).alias("host"))
    rows = docs.select(*told, tidy.alias("tidy")).select("id", "body", "doc", "host", F.posexplode(F.split(F.trim("tidy"), " ?\n ?")).alias("pos", "line")).where("line <> ''")
    return rows.select(
        "id",
        "body",
        "doc",
        "host",
        F.xxhash64("host", "line").alias("key"),
        "pos",
        (F.length("line") - F.length(F.translate("line", " ", "")) + 1).alias("words"),
    )


def frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, max_share: float = MAX_SHARE_OF_HOST) -> DataFrame:
    """Places of lines that more than ``max_docs`` documents, and more than ``max_share`` of the documents, of their host have: id, body, pos, words.

    Counts are partial sums before their shuffle. Only lines that occur often enough to qualify at all are then counted
    by document; a line that a document has twice counts once.
    """
    prepare(docs.sparkSession)
    lines = _lines(docs, doc_id, text, host)
    often = lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("key").checkpoint()
    few = often.count() <= BROADCAST_LINES
    hits = lines.join(F.broadcast(often) if few else often, "key")
    counts = hits.select("key", "host", "doc").distinct().groupBy("key", "host").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    hosts = docs.select(_host(F.col(host)).alias("host"), _document(F.col(doc_id), whole(text)).alias("doc")).distinct().groupBy("host").agg(F.count("*").alias("of"))
    limits = counts.join(hosts, "host").where(F.col("docs") > max_share * F.col("of")).select("key")
    places = hits.join(F.broadcast(limits) if few else limits, "key")
    return places.select("id", "body", "pos", "words").distinct()


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_SHARE_LEFT, max_share: float = MAX_SHARE_OF_HOST) -> DataFrame:
    """One row per document: its id, the counts, base_failed, words_removed and kept.

    Null or empty text: all counts 0 and base_failed (too few words). Null host: a host of its own.
    Repeated rows: one document for the line counts, and each row gets the same verdict.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    counts = text_counts(docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("body"), F.col(text).alias("_raw")), "_raw").drop("_raw")
    removed = frequent_lines(docs, doc_id, text, host, max_docs, max_share).groupBy("id", "body").agg(F.sum("words").alias("gone"))
    same = counts["id"].eqNullSafe(removed["id"]) & (counts["body"] == removed["body"])
    both = counts.join(removed, same, "left").select(counts["*"], F.coalesce(removed["gone"], F.lit(0)).cast("long").alias("words_removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed")
    return both.select(
        F.col("id").alias(doc_id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_share * F.col("n_words"))).alias("kept"),
        "words_removed",
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_SHARE_LEFT, max_share: float = MAX_SHARE_OF_HOST) -> DataFrame:
    """``docs`` without the documents that :func:`judge` rejects and without the lines above the limits, columns as before.

    Null and empty texts go (too few words); null ids and hosts, repeated rows and long texts as in :func:`judge`.
    """
    gone = frequent_lines(docs, doc_id, text, host, max_docs, max_share).groupBy("id", "body").agg(F.collect_set("pos").alias("places"), F.sum("words").alias("gone")).withColumnRenamed("id", "_id").withColumnRenamed("body", "_body")
    counted = text_counts(docs.select(packed(docs), F.col(doc_id).alias("_doc"), F.xxhash64(whole(text)).alias("_key"), F.col(text).alias("_raw")), "_raw")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_body"))
    both = counted.join(gone, same, "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = both.where(~failed & (F.col("n_words") - F.coalesce("gone", F.lit(0)) >= min_share * F.col("n_words")))
    # the lines that stay lie in runs between the removed places, so each line is looked at once
    bounds = F.concat(F.array(F.lit(-1)), F.array_sort("places"), F.array(F.size("_lines")))
    runs = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda at, i: F.slice("_lines", at + 2, F.get(bounds, i + 1) - at - 1))
    shorter = F.array_join(F.flatten(runs), "\n")
    cleaned = F.when(F.col("places").isNull(), F.col("_raw")).otherwise(shorter)
    return kept.withColumn("_lines", F.when(F.col("places").isNotNull(), F.split("_raw", "\n"))).select(*[cleaned.alias(text) if c == text else old for c, old in zip(docs.columns, unpacked(docs.columns), strict=True)])


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
raw AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS times FROM starts),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS place FROM windows WHERE times > 1) GROUP BY 1),
lines AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM raw),
hosts AS (SELECT source, count(DISTINCT doc_id) AS of FROM d GROUP BY 1),
often AS (SELECT source, line, count(DISTINCT doc_id) AS docs FROM lines WHERE line <> '' GROUP BY 1, 2),
over AS (SELECT often.source, line FROM often JOIN hosts ON often.source IS NOT DISTINCT FROM hosts.source WHERE docs > {MAX_DOCS_PER_HOST} AND docs > {MAX_SHARE_OF_HOST}::DOUBLE * of),
gone AS (SELECT doc_id, sum(len(string_split(lines.line, ' ')))::BIGINT AS n FROM lines JOIN over ON lines.line = over.line AND lines.source IS NOT DISTINCT FROM over.source GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS words_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - words_removed >= {MIN_SHARE_LEFT}::DOUBLE * n_words AS kept FROM f
"""


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))

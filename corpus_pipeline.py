"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage reads what the stage before has written, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import bpe, mixing, quality, secrets, simhash
from bidlens.session import scratch


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject, and without lines that too many documents of their host have.

    Null, empty and blank texts go, as they have too few words. Repeated rows get one verdict, each for itself; null ids and
    hosts are told by their text and as a host of their own. Very long texts are judged whole.
    """
    return _measured(quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of repeated rows one stays, of other texts with the same id all that no smaller id is near to. Null, empty and blank
    texts are alike. Rows without an id stay, as nothing names them.
    """
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets replaced by a mark. Null and empty texts stay as they are, repeated rows repeat, long texts are read whole."""
    return _measured(secrets.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it.

    A null source is a source, a null id draws by its text, repeated rows have the same draw; texts without words
    have size 0 and follow their source's rate. An empty table gives an empty one.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids, and whether they decode to the text. A null text is an empty one: no ids."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    told = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = bpe.round_trip(told, path, pattern)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", "lang", "source", n.alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL can't express similar sets, entropy windows and byte-pair merges; the tests hold each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

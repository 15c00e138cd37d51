"""Encoding and decoding in one worker."""

import public_tokenizers as P

import corpus_pipeline
from bidlens.llm import bpe

ROWS = "doc_id long, lang string, source string, text string"


def test_tokens_take_one_python_step_and_are_those_of_two(spark):
    odd = ["", None, "a", "Grüße 👋 " * 50, "x" * 3000, "word " * 400, "ａ́\r\n\t"]
    docs = spark.createDataFrame([(k, "en", None, t) for k, t in enumerate(odd * 3)], ROWS).coalesce(2)
    path = P.path("byte_bpe_50k.tiktoken")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = {r["doc_id"]: bytes(r["ids"]) for r in bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()}
    rows = out.collect()
    assert len(rows) == len(two) and {r["doc_id"]: bytes(r["ids"]) for r in rows} == two
    assert all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in rows)


def test_parts_are_bounded_whatever_the_batch(spark, monkeypatch):
    import pyarrow as pa

    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ñ" * 40, "", "b" * 70, "c" * 500, "d", "e"])], ["k", "t"])
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    made = list(bpe._append([batch], "t", ["x", "y"], lambda texts: (sizes.append(sum(map(len, texts))), [[t.encode() for t in texts]] * 2)[1]))
    assert [b.schema.names for b in made] == [["k", "x", "y"]] * len(made) and [k for b in made for k in b["k"].to_pylist()] == list(range(6))
    assert max(s for s in sizes if s != 500) <= 100 and sum(sizes) == 612

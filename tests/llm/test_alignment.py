"""Alignment of two tokenizers against a plain form that walks each text's tokens one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from bidlens.llm import alignment

FILES = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens_of(text):
    """(id, bytes) of A and of B by the libraries; none if they don't give the text back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = tokens_of.__dict__.setdefault("a", Tokenizer.from_file(FILES[0]))
    b = tokens_of.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=FILES[2]))
    a.encode_special_tokens = True
    letters = {c: bytes([n]) for c, n in alignment._byte_letters().items()}
    of_a = [(i, b"".join(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return (of_a, of_b) if all(b"".join(x[1] for x in side) == (" " + text).encode() for side in (of_a, of_b)) else ([], [])


def ends(side):
    n = 0
    for _, x in side:
        n += len(x)
        yield n


def cut(side, cuts):
    out = [[]]
    for (i, _), n in zip(side, ends(side), strict=True):
        out[-1].append(i)
        if n in cuts:
            out.append([])
    return out[:-1]


def plain(rows):
    docs, held, top = [], Counter(), defaultdict(int)
    for doc_id, text in rows:
        a, b = tokens_of(text) if text else ([], [])
        cuts = set(ends(a)) & set(ends(b))
        groups = list(zip(cut(a, cuts), cut(b, cuts), strict=True))
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        held.update(links.keys())
        docs.append((doc_id, len(a), len(b), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), len(groups)))
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    for doc_id, n_a, n_b, links, groups, n in docs:
        best = sum(m for p, m in links.items() if held[p] == top[p[0]])
        yield doc_id, n_a, n_b, n, sum(links.values()), best, sum(m * held[p] for p, m in links.items()), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""


def odd_rows():
    draw = random.Random(3)
    odd = [None, "", " ", "  ", "a", "▁x", " lead", "trail ", "a▁b", "tab\tq\r\n\n x", "é😀 汉字かな mixed ελ", "<|endoftext|> <s> </s> <unk> <0x0A>", "a" * 3000, "x\x00y"]
    odd += ["==== ---- ###   \n\n\n   z", "\xa0nb\xa0sp", "don't we'll I'm 'S 12345 6,7", "ﬁ ① é ²", "​zw", "\x1cfs\x1d y", " " * 500, "\n" * 300, "é" * 2001 + "!" * 77]
    odd += ["".join(draw.choice("ab é\n.1'\tß€’“汉😀 ") for _ in range(draw.randint(1, 400))) for _ in range(60)]
    return [(i if i != 3 else None, t) for i, t in enumerate(odd)] + [(9, odd[9]), (9, odd[9])]


def digest(df):
    return sorted((tuple(r) for r in df.withColumnRenamed("groups", "groups_sha256").select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_ROWS, 7])
def test_equals_the_plain_form_on_odd_rows(spark, limit):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_best", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("_place", F.lit(2))
    out = alignment.scored(docs, *FILES, hashed=True, limit=limit)
    assert digest(out) == sorted(plain(rows), key=str)
    assert {"_text", "_place"} <= set(out.columns)


def test_equals_the_plain_form_on_the_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert digest(alignment.op11_alignment(spark, sf)) == sorted(plain(rows), key=str)


def test_no_rows_and_written_groups(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.scored(none, *FILES).collect() == []
    row = alignment.align(spark.createDataFrame([(1, "one unlikeliest word")], "doc_id bigint, text string"), *FILES).first()
    a, b = tokens_of("one unlikeliest word")
    groups = [[side.split(",") for side in g.split("|")] for g in row["groups"].split(";")]
    assert [int(i) for x, _ in groups for i in x] == [i for i, _ in a] and [int(i) for _, y in groups for i in y] == [i for i, _ in b]
    assert sum(p["links"] for p in row["pairs"]) == row["n_links"]


def test_parts_of_a_long_text_change_nothing():
    text = "word and 12 more, é " * 4000 + "汉字 " * 50 + "x" * 30_000
    parts = alignment.parted(text, 10_000)
    assert len(parts) > 5 and "".join(parts) == " " + text
    n, sha, keys, count = alignment._long(alignment.aligner(*FILES), parts, True)
    (want,) = plain([(1, text)])
    assert (*n, sha.decode()) == (*want[1:5], want[-1]) and count.sum() == n[3]
    assert alignment._long(alignment.aligner(*FILES), [" good", " bad▁"], True)[0] == [0, 0, 0, 0]


def test_wide_groups_are_counted_not_listed():
    """Two made-up coders whose tokens meet nowhere but at the end: one group of a hundred million links."""
    import numpy as np

    n = 10_000
    a = alignment.Coder([b"x", b"xx"], lambda texts: [np.array([0] + [1] * n + [0]) for _ in texts], True)
    b = alignment.Coder([b"xx"], lambda texts: [np.zeros(n + 1, np.int64) for _ in texts], True)
    counts, _, keys, count, _ = alignment.Aligner(a, b).align(["x" * (2 * n + 2)] * 2)
    assert counts.T.tolist() == [[n + 2, n + 1, 1, (n + 2) * (n + 1)]] * 2
    assert keys.tolist() == [0, 1, 2, 3] and count.tolist() == [2 * (n + 1), n * (n + 1)] * 2

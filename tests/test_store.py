"""Stored tables by version, and the text index that lies in them, against plain dictionaries and the scan."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from bidlens.functions import search
from bidlens.operators.store import Store
from bidlens.operators.text_index import TextIndex, both, either, without

SCHEMA = StructType().add("k", LongType()).add("v", StringType()).add("f", StringType())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_merges_touch_their_buckets_and_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    content = lambda version=None: {r["k"]: (r["v"], r["f"]) for r in store.read(version).collect()}
    assert store.version() == 0 and content() == {}
    want = {k: (f"v{k}", "a") for k in range(200)} | {None: ("none", "a")}
    assert store.merge(frame([(k, *x) for k, x in want.items()])) == 1 and content() == want
    before, folders = files(tmp_path / "s"), store.folders()
    bucket = store.bucket_of(7)
    assert store.merge(frame([(7, "new", "b")])) == 2
    changed = {b for b, f in store.folders().items() if folders.get(b) != f}
    assert changed == {bucket} and before < files(tmp_path / "s")
    assert content() == want | {7: ("new", "b")} and content(1) == want
    assert store.merge(frame([]), gone=frame([(None, "", ""), (7, "", ""), (999, "", "")]).select("k")) == 3
    assert content() == {k: x for k, x in want.items() if k not in (None, 7)}
    everything = store.read().select("k")
    assert store.merge(frame([]), gone=everything) == 4 and content() == {} and store.folders() == {}
    assert store.merge(frame([(1, "x", "a")]), mark="batch 9") == 5 == store.merge(frame([(1, "y", "b")]), mark="batch 9") and content() == {1: ("x", "a")}


def test_a_merge_that_fails_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=4)
    store.merge(spark.range(50).select(F.col("id").alias("k"), F.lit("v").alias("v"), F.lit("f").alias("f")))
    broken = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise("w").alias("v"), F.lit("g").alias("f"))
    with pytest.raises(Exception, match="broken"):
        store.merge(broken)
    assert store.version() == 1 and store.read().where("v = 'v'").count() == 50
    slow = Store(spark, store.path, SCHEMA, ["k"], buckets=4)
    slow.version = lambda: 0  # one that began before the other ended
    with pytest.raises(Exception, match="(?i)exist"):
        slow.merge(spark.createDataFrame([(1, "z", "z")], SCHEMA))
    assert store.read().where("v = 'v'").count() == 50


def test_upsert_tells_outcomes_and_writes_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=16)
    store.merge(spark.createDataFrame([(k, "v", "a") for k in range(40)], SCHEMA))
    folders = store.folders()
    told = store.upsert(spark.createDataFrame([(3, "w", "b"), (4, "same", "a"), (99, "n", "c"), (5, "null", None)], SCHEMA), "f")
    assert dict(map(tuple, told.collect())) == {3: "actualizada", 4: "igual", 99: "nueva", 5: "actualizada"}
    changed = {b for b, f in store.folders().items() if folders.get(b) != f}
    assert changed == {store.bucket_of(k) for k in (3, 99, 5)}
    assert {r["k"]: r["v"] for r in store.read().where("k in (3, 4, 5, 99)").collect()} == {3: "w", 4: "v", 5: "null", 99: "n"}


def test_index_equals_the_scan_and_follows_changes(spark, tmp_path):
    draw = random.Random(4)
    make = lambda: " ".join(draw.choice(["red", "Réd", "wide", "widen", "la", "de", "del", "x-y", "ñu", "12"]) for _ in range(draw.randrange(0, 25)))
    texts = {k: make() for k in range(120)} | {500: None, 501: "", 502: "?! --"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "k bigint, t string")
    index = TextIndex.of(frame(texts), "k", "t", str(tmp_path / "i"), buckets=8)
    w = search.searchable(F.col("t"))
    cases = [
        (lambda i: i.phrase("la"), search.phrase(w, "la")),
        (lambda i: i.phrase("De la red"), search.phrase(w, "de la red")),
        (lambda i: i.phrase("x-y red"), search.phrase(w, "x y red")),
        (lambda i: i.prefix("wid"), search.prefix(w, "wid")),
        (lambda i: i.prefix("la de"), search.prefix(w, "la de")),
        (lambda i: i.near("nu", "wide", 2), search.near(w, "nu", "wide", 2)),
        (lambda i: i.near("la", "la", 0), search.near(w, "la", "la", 0)),
        (lambda i: without(both(i.phrase("red"), either(i.phrase("12"), i.phrase("del"))), i.phrase("nu")), search.phrase(w, "red") & (search.phrase(w, "12") | search.phrase(w, "del")) & ~search.phrase(w, "nu")),
        (lambda i: i.phrase("absent"), search.phrase(w, "absent")),
    ]

    def check(which):
        for k in which:
            ask, scan = cases[k]
            got = [r[0] for r in ask(index).collect()]
            assert sorted(got) == sorted(r[0] for r in frame(texts).where(scan).select("k").collect()), k

    check(range(len(cases)))
    folders = index.terms.folders()
    texts |= {3: (texts[3] or "") + " zebra", 4: None, 900: "red zebra"}
    del texts[5]
    index.update(frame({k: texts[k] for k in (3, 4, 900)} | {6: texts[6]}), "k", "t", gone=spark.createDataFrame([(5,), (12345,)], "id bigint"))
    assert sorted(r[0] for r in index.phrase("zebra").collect()) == [3, 900]
    check((0, 4, 6, 7))
    folders = index.terms.folders()
    texts[7] = (texts[7] or "") + " lonely"
    index.update(frame({7: texts[7]}), "k", "t")
    assert {b for b, f in index.terms.folders().items() if folders.get(b) != f} == {index.terms.bucket_of("lonely")}


def dealt(spark):
    """Records that all shuffles so far have written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_an_index_shuffles_terms_of_many_notices_together_and_once(spark, tmp_path):
    draw = random.Random(5)
    texts = spark.createDataFrame([(k, " ".join(draw.choice("abcdefgh") + draw.choice("xyz") for _ in range(60))) for k in range(2000)], "k bigint, t string").coalesce(2)
    want = {r["k"] for r in texts.where(search.phrase(search.searchable(F.col("t")), "ax by")).collect()}
    before = dealt(spark)
    index = TextIndex.of(texts, "k", "t", str(tmp_path / "i"), buckets=4)
    assert dealt(spark) - before < 8_000  # about 45,000 postings
    assert {r[0] for r in index.phrase("ax by").collect()} == want
    before, folders = dealt(spark), index.terms.folders()
    index.update(texts, "k", "t")  # as they were
    assert dealt(spark) - before < 8_000 and index.terms.folders() == folders
    longer = texts.where("k % 3 = 0").withColumn("t", F.concat(F.lit("ax "), "t"))
    index.update(longer, "k", "t", texts.where("k % 3 = 1").select(F.col("k").alias("id")))
    left = longer.unionByName(texts.where("k % 3 = 2"))
    for words in ("ax by", "cz", "ax ax"):
        assert sorted(r[0] for r in index.phrase(words).collect()) == sorted(r["k"] for r in left.where(search.phrase(search.searchable(F.col("t")), words)).collect())


def test_a_first_merge_reads_its_rows_once_and_later_ones_twice(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=4), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k, "v", "a") for k in range(300)], SCHEMA).mapInArrow(counted, SCHEMA)
    store.merge(rows)
    assert seen.value == 300
    store.merge(rows, gone=spark.createDataFrame([(5, "", ""), (700, "", "")], SCHEMA).select("k"))
    assert seen.value == 900 and store.read().count() == 300


def test_counters_by_profile_need_no_join_and_names_are_sieved(spark):
    from bidlens.operators import expiries, inbox

    found = lambda *p: [(x, 1.0, "r") for x in p]
    rows = [(1, "c1", None, found("a", "b")), (2, "c1", None, found("a")), (3, "c2", "descartado", found("a")), (4, "c3", "siguiendo", found("a")), (5, "c4", None, [])]
    n = spark.createDataFrame(rows, "notice_id bigint, case_key string, review_state string, found array<struct<profile: string, score: double, reason: string>>")
    assert {r["profile"]: r["cases"] for r in inbox.by_profile_in_row(n).collect()} == {"a": 2, "b": 1}
    names = ["Ácme Obras, S.L.", "acme  obras SL", "OBRAS Acme", "Acme (Obras) S.A.U.", "Acme", None]
    entry = spark.createDataFrame([(k, x, "b", k) for k, x in enumerate(names)], "notice_id bigint, awardee string, buyer string, money int")
    got = expiries.contracts_of(entry, "ACME obras")
    assert sorted(r["notice_id"] for r in got.collect()) == [0, 1, 3] and expiries.contracts_of(entry, "S.L.").count() == 0
    assert "forall" in got._jdf.queryExecution().optimizedPlan().toString()

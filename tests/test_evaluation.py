"""Stored evaluation, kept results, checks, state of keys, and sources side by side."""

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.operators import diagnostics, evaluation, results, rules
from bidlens.operators.store import Store
from bidlens.streaming import ingest, keyed, matching

ROW = "key string, fingerprint string, text_norm string, region string, amount double, source string, cpv array<string>"
EVAL = ("evaluated", "complete", "why", "created", "updated", "removed", "orphans")


def notice(k, text="phishing", amount=200_000.0, mark=None):
    return (f"n{k}", mark or f"{text} {amount}", text, None, amount, "s", [])


def profile(name="p", strong=("phishing",), **more):
    return rules.Profile(name, strong=strong, **more)


def stored(spark, path):
    return evaluation.Evaluation(spark, str(path), T.StructField("key", T.StringType()), buckets=2)


def test_what_is_judged_and_why(spark, tmp_path):
    e = stored(spark, tmp_path / "e")
    take = lambda *rows: dict(map(tuple, e.take(spark.createDataFrame(list(rows), ROW)).collect()))
    run = lambda *profiles, at="t", incremental=True: (lambda d: tuple(d[k] for k in EVAL))(e.evaluate(profiles, at, incremental))
    held = lambda: {(r["key"], r["profile"]): (r["score"], r["created"], r["updated"]) for r in e.matches.read().collect()}
    take(*[notice(i) for i in range(3)])
    assert e.pending().count() == 3
    assert run(profile(), at="t1") == (3, True, evaluation.UNKNOWN, 3, 0, 0, 0) and e.pending().count() == 0
    assert take(notice(1)) == {"n1": "igual"} and run(profile(), at="t2") == (0, False, None, 0, 0, 0, 0)
    assert take(notice(1, amount=90.0), notice(9)) == {"n1": "actualizada", "n9": "nueva"}
    assert run(profile(), at="t3") == (2, False, None, 1, 1, 0, 0)
    assert held() == {("n0", "p"): (3.5, "t1", "t1"), ("n1", "p"): (3.0, "t1", "t3"), ("n2", "p"): (3.5, "t1", "t1"), ("n9", "p"): (3.5, "t3", "t3")}
    assert run(profile(query_terms=("other", "dmarc"))) == (0, False, None, 0, 0, 0, 0)
    assert rules.fingerprint([profile(strong=("phishing", "dmarc"))]) != rules.fingerprint([profile(strong=("dmarc", "phishing"))])
    assert run(profile(strong=("dmarc",)))[1:] == (True, evaluation.CHANGED, 0, 0, 4, 0) and held() == {}
    both = (profile(), profile("q"))
    assert run(*both)[3:] == (8, 0, 0, 0)
    assert run(profile(), profile("q", active=False))[1:] == (True, evaluation.CHANGED, 0, 0, 0, 4)
    assert run(profile()) == (0, False, None, 0, 0, 0, 0)  # leaving out a profile that wasn't active forces nothing
    assert run(profile(active=False))[1:] == (True, evaluation.CHANGED, 0, 0, 0, 4) and held() == {}
    assert run(profile(), incremental=False)[:3] == (4, True, None)


def test_a_stream_under_other_rules_judges_all(spark, tmp_path, monkeypatch):
    e = stored(spark, tmp_path / "e")
    schema = ROW + ", at int"
    source = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda *p: [(d["evaluated"], d["complete"]) for d in matching.run_stored(spark.readStream.schema(schema).parquet(source), e, p, "at", str(tmp_path / "ck"), "t")]
    put(notice(1, "old"), notice(2), notice(1))
    assert run(profile()) == [(2, True)]
    put(notice(3), notice(2))
    assert run(profile()) == [(1, False)] and run(profile()) == [(0, False)]
    put(notice(4))
    assert run(profile(strong=("phish",))) == [(4, True)]
    monkeypatch.setattr(rules, "ENGINE", "99")
    assert run(profile(strong=("phish",))) == [(4, True)] and e.matches.read().count() == 4


def test_preview_counts_notices_once(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "k int, title string")
    hit = lambda ids, p: spark.createDataFrame([(k, p) for k in ids], "k int, profile string")
    r = evaluation.preview_summary(rows, hit(range(4), "a").union(hit(range(2), "b")), hit(range(2, 12), "a"), "k", ["title"]).first()
    assert (r["before"], r["after"], r["enter"], r["leave"]) == (4, 10, 8, 2)
    assert [tuple(x) for x in r["enter_sample"]] == [(k, f"t{k}") for k in range(4, 9)] and [x["k"] for x in r["leave_sample"]] == [0, 1]
    none = evaluation.preview_summary(rows, hit([1], "a").limit(0), hit([1], "a").limit(0), "k", ["title"]).first()
    assert tuple(none) == (0, 0, 0, 0, [], [])


def test_results_are_kept_by_version(spark, tmp_path):
    schema = T.StructType().add("k", T.LongType()).add("v", T.StringType())
    store, made = Store(spark, str(tmp_path / "s"), schema, ["k"], buckets=2), []
    store.merge(spark.createDataFrame([(k, "a") for k in range(5)], schema))
    kept = results.Kept(spark, str(tmp_path / "r"), [store], most=2)

    def get(**arguments):
        def make():
            made.append(arguments)
            return store.read().groupBy("v").agg(F.count("*").alias("n"))

        return sorted(map(tuple, kept.get("counts", arguments, make).collect()))

    assert get(day="1") == [("a", 5)] == get(day="1") and len(made) == 1
    assert get(day="2") == [("a", 5)] and len(made) == 2
    store.merge(spark.createDataFrame([(1, "b")], schema))
    assert get(day="1") == [("a", 4), ("b", 1)] == get(day="1") and len(made) == 3
    assert kept.index.read().count() == 1  # those of the version before are gone
    assert get(day="3") and get(day="4") and kept.index.read().count() <= 2


def test_checks_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "f", "f"), (2, " ", "f", None), (3, None, "f", "f"), (4, "b", "g", "f"), (4, "b", "g", "g")], "k int, t string, now string, judged string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    r = diagnostics.checked(rows, ids(1, 1, 9, 9, 8), ids(1, 7), "k", "t", "now", "judged").first()
    assert tuple(r) == (5, 2, 2, 1, 5, 3, 2, 1, 1)
    assert tuple(diagnostics.checked(rows.limit(0), ids(1).limit(0), ids(1).limit(0), "k", "t", "now", "judged").first()) == (0,) * 9
    seen_rows, seen = diagnostics.observed(rows, "t")
    seen_rows.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"rows": 5, "without_text": 2}


KEYED = "key string, seq bigint, fingerprint string"


def test_keyed_state_over_batches_and_restarts(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 3, "y"), ("b", 1, None), ("a", 2, "x"), (None, 5, "q")], [("a", 3, "y"), ("a", 4, "y"), ("b", 2, None), ("b", 3, "z"), ("c", 1, "n"), ("a", 1, "x")]]
    run = lambda name: keyed.run(spark.readStream.schema(KEYED).parquet(str(tmp_path / "in")), str(tmp_path / name), str(tmp_path / f"{name}-ck"))
    held = lambda name: sorted(map(tuple, spark.read.schema(keyed.OUTPUT).parquet(str(tmp_path / name)).collect()), key=str)
    for part in batches:
        spark.createDataFrame(part, KEYED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("two")
    run("two")
    run("one")
    assert held("two") == held("one") == sorted([("a", 1, "x", "nueva"), ("a", 2, "x", "igual"), ("a", 3, "y", "actualizada"), ("a", 4, "y", "igual"), ("b", 1, None, "nueva"), ("b", 2, None, "igual"), ("b", 3, "z", "actualizada"), ("c", 1, "n", "nueva"), (None, 5, "q", "nueva")], key=str)


def test_keys_are_forgotten_in_time(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame(list(rows), KEYED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: keyed.run(spark.readStream.schema(KEYED).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), timedelta(milliseconds=1))
    put(("a", 1, "x"))
    run()
    put(("a", 2, "x"))
    run()
    assert sorted(r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["nueva", "nueva"]


def test_a_broken_source_is_alone(spark, tmp_path):
    for name in ("good", "late"):
        spark.range(5).write.parquet(str(tmp_path / name))
    taken = []
    runs = Store(spark, str(tmp_path / "runs"), ingest.RUN, ["run", "source", "part"], buckets=1)

    def source(name, fails=False, part=""):
        def each(batch, k):
            if fails:
                raise ValueError("no service")
            taken.append((name, batch.count()))

        return ingest.Source(name, lambda s: s.readStream.schema("id bigint").parquet(str(tmp_path / name / part)), each, str(tmp_path / f"ck-{name}{part}{fails}"), part)

    (tmp_path / "bad").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "bad"))
    log = ingest.ingest(spark, [[source("good"), source("bad", True), source("good", part="2019")], [source("late")]], runs, 1)
    assert sorted(taken) == [("good", 5), ("late", 5)] and taken[-1][0] == "late"
    assert [(r["source"], r["part"], r["seen"], r["ok"]) for r in log] == [("good", "", 5, True), ("bad", "", 0, False), ("good", "2019", 0, True), ("late", "", 5, True)] or log
    rows = {(r["source"], r["part"]): r for r in runs.read().collect()}
    assert rows["bad", ""]["ok"] is False and rows["bad", ""]["error"] and rows["good", "2019"]["ok"] and rows["good", ""]["seen"] == 5 and rows["late", ""]["stage"] == 1
    again = ingest.ingest(spark, [[source("good"), source("bad")]], runs, 2)  # what was committed isn't read again
    assert [r["seen"] for r in again] == [0, 3] and runs.read().count() == 6

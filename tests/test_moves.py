"""What stores and evaluations move: keys and fingerprints first, whole rows once."""

import glob

from pyspark.sql import types as T

from bidlens.operators import evaluation, rules
from bidlens.operators.store import Store

ROW = "key string, fingerprint string, text_norm string"
NOTICE = ROW + ", region string, amount double, source string, cpv array<string>"


def test_an_upsert_keeps_texts_out_of_its_outcomes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), T._parse_datatype_string(ROW), ["key"], buckets=4)
    take = lambda *rows, mark=None: dict(map(tuple, store.upsert(spark.createDataFrame(list(rows), ROW), "fingerprint", mark).collect()))
    held = lambda: {r["key"]: (r["fingerprint"], r["text_norm"]) for r in store.read().collect()}
    assert take(*[(k, k, "old") for k in "abcdefgh"], (None, None, "old")) == dict.fromkeys([*"abcdefgh", None], "nueva")
    before, version = store.folders(), store.version()
    assert take(("a", "a", "not written"), (None, None, "not written")) == {"a": "igual", None: "igual"} and (store.version(), store.folders()) == (version, before)
    assert take(("b", "other", "new"), ("c", "c", "not written"), ("i", None, "new"), mark="m") == {"b": "actualizada", "c": "igual", "i": "nueva"}
    want = {k: (k, "old") for k in "acdefgh"} | {None: (None, "old"), "b": ("other", "new"), "i": (None, "new")}
    touched = {store.bucket_of("b"), store.bucket_of("i")}
    assert held() == want and store.read().count() == 10 and {b for b, f in store.folders().items() if before.get(b) != f} == touched
    assert take(("b", "again", "late"), mark="m") == {"b": "actualizada"} and held() == want
    assert take(("i", "now", "x"), (None, "now", "x")) == {"i": "actualizada", None: "actualizada"} and held() == want | {"i": ("now", "x"), None: ("now", "x")}
    tables = glob.glob(f"{tmp_path}/s/outcome/*")
    assert len(tables) == 5 and all("text_norm" not in spark.read.parquet(t).columns for t in tables)


def test_a_pass_judges_the_same_whether_keys_are_sent_or_shuffled(spark, tmp_path, monkeypatch):
    told = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(evaluation, "BROADCAST_KEYS", most)
        e = evaluation.Evaluation(spark, str(tmp_path / f"e{most}"), T.StructField("key", T.StringType()), buckets=2)
        one = lambda k, text: (k, text, text, None, 9.0, "s", [])
        profiles, out = [rules.Profile("p", strong=("phishing",))], []
        for rows in ([one("a", "phishing"), one("b", "nothing")], [one("b", "phishing too"), one("c", "phishing"), one("a", "phishing")]):
            e.take(spark.createDataFrame(rows, NOTICE))
            out.append(e.evaluate(profiles, f"t{len(out)}", incremental=True))
        rows = e.notices.read()
        plan = e._of(rows, rows.select("key"))._jdf.queryExecution().executedPlan().toString()
        assert most == 0 or ("BroadcastHashJoin" in plan and "hashpartitioning" not in plan)
        assert [x["evaluated"] for x in out] == [2, 2] and e.pending().count() == 0
        told.append((out, sorted(map(tuple, e.matches.read().collect()))))
    assert told[0] == told[1] and len(told[0][1]) == 3

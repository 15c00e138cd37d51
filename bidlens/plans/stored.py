"""Queries of stored tables, the text index, evaluations and streams with state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.operators import diagnostics, evaluation, rules
from bidlens.operators.store import Store
from bidlens.operators.text_index import TextIndex, both, either, without
from bidlens.session import scratch
from bidlens.sources.adapter import NOTICES_SQL, notices
from bidlens.streaming import changes, keyed

BUCKETS = 8


def _table(s, rows: DataFrame) -> DataFrame:
    """``rows`` as a table, for what reads them more than once."""
    path = scratch(s, "rows")
    rows.write.option("compression", "zstd").parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def _state(s, d) -> DataFrame:
    return _table(s, notices(s, d).select("notice_id", "source", "lot", F.col("state").alias("fingerprint"), "procedure", "region"))


def _store(s, rows: DataFrame) -> Store:
    return Store(s, scratch(s, "store"), rows.schema, ["notice_id"], buckets=BUCKETS)


def merged(s, d) -> DataFrame:
    """All notices; then the regional ones closed, those of lot 1 from the EU taken out, and the urgent ones written back."""
    rows = _state(s, d)
    store = _store(s, rows)
    store.merge(rows)
    store.merge(rows.where("source = 'regional'").withColumn("fingerprint", F.lit("cerrada")), rows.where("source = 'eu' and lot = '1'"))
    store.merge(rows.where("procedure = '1-urgent'"), mark="urgent")
    store.merge(rows, mark="urgent")  # under a mark that is there: nothing
    return store.read().select("notice_id", "source", "fingerprint")


MERGED_SQL = NOTICES_SQL + """SELECT notice_id, source, CASE WHEN procedure = '1-urgent' OR source <> 'regional' THEN state ELSE 'cerrada' END AS fingerprint
FROM valued WHERE procedure = '1-urgent' OR NOT (source = 'eu' AND lot = '1')"""


def upserted(s, d) -> DataFrame:
    """The first three lots are stored; then lots 2 to 5 come, the urgent ones with another state."""
    rows = _state(s, d)
    store = _store(s, rows)
    store.merge(rows.where("lot in ('1', '2', '3')"))
    came = rows.where("lot in ('2', '3', '4', '5')").withColumn("fingerprint", F.when(F.col("procedure") == "1-urgent", F.lit("otra")).otherwise(F.col("fingerprint")))
    told = store.upsert(came, "fingerprint")
    return told.join(store.read(), "notice_id").groupBy("outcome", "fingerprint").agg(F.count("*").alias("notices"))


UPSERTED_SQL = NOTICES_SQL + """SELECT CASE WHEN lot IN ('4', '5') THEN 'nueva' WHEN procedure = '1-urgent' THEN 'actualizada' ELSE 'igual' END AS outcome,
  CASE WHEN procedure = '1-urgent' THEN 'otra' ELSE state END AS fingerprint, count(*) AS notices FROM valued WHERE lot IN ('2', '3', '4', '5') GROUP BY 1, 2"""


def _docs(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


def indexed(s, d) -> TextIndex:
    return TextIndex.of(_docs(s, d), "doc_id", "text", buckets=BUCKETS)


def index_updated(s, d) -> DataFrame:
    """German texts get words more, French ones go, English ones come again as they were; then two phrases are asked for."""
    docs = _docs(s, d)
    index = TextIndex.of(docs, "doc_id", "text", buckets=BUCKETS)
    longer = docs.where("lang in ('de', 'en')").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" zebra Crossing"))).otherwise(F.col("text")))
    index.update(longer, "doc_id", "text", docs.where("lang = 'fr'").select(F.col("doc_id").alias("id")))
    return either(index.phrase("zebra crossing"), index.phrase("on the")).withColumnRenamed("id", "doc_id")


WORDS_SQL = "WITH t AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' ' AS w FROM documents) "
ASKED = {
    "index_and": (lambda i: both(i.phrase("The"), i.phrase("from")), "contains(w, ' the ') AND contains(w, ' from ')"),
    "index_prefix": (lambda i: i.prefix("licen"), "contains(w, ' licen')"),
    "index_phrase": (lambda i: either(i.phrase("on the"), i.phrase("of the")), "contains(w, ' on the ') OR contains(w, ' of the ')"),
    "index_not": (lambda i: without(either(i.phrase("que"), i.phrase("de")), i.phrase("la")), "(contains(w, ' que ') OR contains(w, ' de ')) AND NOT contains(w, ' la ')"),
    "index_near": (lambda i: i.near("from", "the", 3), "regexp_matches(w, ' from ([^ ]+ ){0,3}the ') OR regexp_matches(w, ' the ([^ ]+ ){0,3}from ')"),
}


def searched(s, d) -> DataFrame:
    """Notices by words of their whole search text: title, buyer and region."""
    n = _table(s, notices(s, d).select("notice_id", "title", "buyer", "region"))
    index = TextIndex.of(n.select("notice_id", F.concat_ws(" \n", "title", "buyer", "region").alias("search_text")), "notice_id", "search_text", buckets=BUCKETS)
    found = both(index.prefix("Réd"), either(index.prefix("customer 00000001"), index.phrase("nation_1")))
    return n.join(found.withColumnRenamed("id", "notice_id"), "notice_id", "left_semi").select("notice_id", "title", "buyer", "region")


SEARCHED_SQL = NOTICES_SQL + """, told AS (SELECT *, ' ' || trim(regexp_replace(lower(concat_ws(' ', title, buyer, region)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' ' AS w FROM valued)
SELECT notice_id, title, buyer, region FROM told WHERE contains(w, ' red') AND (contains(w, ' customer 00000001') OR contains(w, ' nation_1 '))"""

FIRST = (rules.Profile("A", strong=("disgust", "licen"), weak=("tion", "ment"), context=("from", "ung"), exclude=("quel",), min_amount=500), rules.Profile("B", strong=("cion",)))
LATER = (rules.Profile("A", strong=("disgust", "licen"), weak=("tion", "ment"), context=("from", "ung"), exclude=("quel",), min_amount=1000), rules.Profile("C", strong=("heit",)))


def _evaluated(s, d) -> tuple[evaluation.Evaluation, list[dict]]:
    """English and German texts under the first rules, then Spanish ones come, then the rules change with nothing new."""
    rows = rules.documents_as_notices(s.read.parquet(f"{d}/documents.parquet")).withColumn("fingerprint", F.sha2("text_norm", 256))
    e = evaluation.Evaluation(s, scratch(s, "evaluated"), T.StructField("doc_id", T.LongType()), BUCKETS)
    done = []
    for langs, profiles in ((("en", "de"), FIRST), (("de", "es"), FIRST), ((), LATER)):
        if langs:
            e.take(rows.where(F.col("region").isin(*langs)))
        done.append(e.evaluate(profiles, f"t{len(done)}", incremental=True))
    return e, done


def evaluated(s, d) -> DataFrame:
    return _evaluated(s, d)[0].matches.read()


def evaluation_log(s, d) -> DataFrame:
    _, done = _evaluated(s, d)
    names = ("evaluated", "created", "removed", "orphans")
    return s.createDataFrame([(k, x["complete"], x["why"], *[x[n] for n in names]) for k, x in enumerate(done)], "pass int, complete boolean, why string, evaluated bigint, created bigint, removed bigint, orphans bigint")


def _hit(term: str) -> str:
    return f"regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_]){term}')"


def _rules_sql(name: str, p: rules.Profile) -> str:
    """Verdict, score and reason of the profiles above, which have neither codes nor regions."""
    listed = lambda terms: "list_filter([" + ", ".join(f"CASE WHEN {_hit(t)} THEN '{t}' END" for t in terms) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
    out = " OR ".join(map(_hit, p.exclude)) or "false"
    return f"""{name}h AS (SELECT doc_id, lang, amount, {listed(p.strong)} AS s, {listed(p.weak)} AS w, {listed(p.context)} AS c, {out} AS x FROM doc),
{name} AS (SELECT doc_id, lang, '{p.name}' AS profile, CASE WHEN len(s) > 0 THEN 3.0::DOUBLE + 0.5::DOUBLE * (len(s) - 1) ELSE 0 END + CASE WHEN len(w) > 0 AND len(c) > 0 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN amount >= 100000 THEN 0.5::DOUBLE ELSE 0 END AS score,
  concat_ws('; ', CASE WHEN len(s) > 0 THEN 'strong: ' || array_to_string(s[1:3], ', ') END, CASE WHEN len(w) > 0 AND len(c) > 0 THEN 'weak: ' || array_to_string(w[1:3], ', ') END, CASE WHEN len(w) > 0 AND len(c) > 0 THEN 'context: ' || array_to_string(c[1:3], ', ') END, CASE WHEN amount >= 100000 THEN 'large amount' END) AS reason
  FROM {name}h WHERE len(s) + len(w) > 0 AND NOT x AND amount >= {p.min_amount} AND (len(s) > 0 OR len(c) > 0))"""


EVALUATED = "WITH doc AS (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g') AS n, lang, n_chars::DOUBLE AS amount FROM documents WHERE lang IN ('en', 'de', 'es')), " + ", ".join(_rules_sql(n, p) for n, p in zip(("a1", "b1", "a2", "c2"), FIRST + LATER, strict=True)) + """,
old AS (SELECT * FROM a1 UNION ALL SELECT * FROM b1), new AS (SELECT * FROM a2 UNION ALL SELECT * FROM c2) """
EVALUATED_SQL = EVALUATED + """SELECT doc_id, profile, new.score, new.reason, CASE WHEN old.doc_id IS NULL THEN 't2' WHEN new.lang = 'es' THEN 't1' ELSE 't0' END AS created,
  CASE WHEN old.doc_id IS NULL OR old.score <> new.score OR old.reason <> new.reason THEN 't2' WHEN new.lang = 'es' THEN 't1' ELSE 't0' END AS updated FROM new LEFT JOIN old USING (doc_id, profile)"""
LOG_SQL = EVALUATED + """SELECT 0 AS pass, true AS complete, 'no record of the rules' AS why, (SELECT count(*) FROM doc WHERE lang IN ('en', 'de')) AS evaluated, (SELECT count(*) FROM old WHERE lang IN ('en', 'de')) AS created, 0::BIGINT AS removed, 0::BIGINT AS orphans
UNION ALL SELECT 1, false, NULL, (SELECT count(*) FROM doc WHERE lang = 'es'), (SELECT count(*) FROM old WHERE lang = 'es'), 0, 0
UNION ALL SELECT 2, true, 'the rules have changed', (SELECT count(*) FROM doc), (SELECT count(*) FROM new ANTI JOIN old USING (doc_id, profile)), (SELECT count(*) FROM old ANTI JOIN new USING (doc_id, profile) WHERE profile = 'A'), (SELECT count(*) FROM old WHERE profile = 'B')"""


def preview(s, d) -> DataFrame:
    rows = rules.documents_as_notices(s.read.parquet(f"{d}/documents.parquet"))
    out = evaluation.preview_summary(rows.select("doc_id", "region"), rules.matches(rows, FIRST, "doc_id"), rules.matches(rows, LATER, "doc_id"), "doc_id", ["region"])
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["doc_id"].cast("string")), ",").alias(c)
    return out.select("before", "after", "enter", "leave", ids("enter_sample"), ids("leave_sample"))


PREVIEW_SQL = EVALUATED.replace(" WHERE lang IN ('en', 'de', 'es')", "") + """, o AS (SELECT DISTINCT doc_id FROM old), n AS (SELECT DISTINCT doc_id FROM new), i AS (SELECT * FROM n EXCEPT SELECT * FROM o), l AS (SELECT * FROM o EXCEPT SELECT * FROM n)
SELECT (SELECT count(*) FROM o) AS before, (SELECT count(*) FROM n) AS after, (SELECT count(*) FROM i) AS enter, (SELECT count(*) FROM l) AS leave,
  (SELECT coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') FROM (SELECT doc_id FROM i ORDER BY doc_id LIMIT 5)) AS enter_sample, (SELECT coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') FROM (SELECT doc_id FROM l ORDER BY doc_id LIMIT 5)) AS leave_sample"""


def checks(s, d) -> DataFrame:
    """Documents as stored notices, matches of some that labels name, and an index that has those of two languages."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"), "lang", "source")
    rows = docs.withColumns({"fingerprint": F.sha2("text", 256), "judged": F.when(F.col("source") != "src3", F.sha2("text", 256))})
    labels = s.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 10_000_000).otherwise(0)).alias("doc_id"))
    return diagnostics.checked(rows, labels, docs.where("lang in ('en', 'de')").select("doc_id"), "doc_id", "text", "fingerprint", "judged")


CHECKS_SQL = """WITH n AS (SELECT doc_id, lang, source, CASE WHEN lang <> 'fr' THEN text END AS text FROM documents), m AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END AS doc_id FROM labels),
b AS (SELECT *, coalesce(trim(text) = '', true) AS empty FROM n)
SELECT (SELECT count(*) FROM n) AS notices, (SELECT count(*) FROM b WHERE empty) AS without_text, (SELECT count(*) FROM n WHERE source = 'src3' AND text IS NOT NULL) AS pending, (SELECT count(*) FROM (SELECT doc_id FROM n GROUP BY doc_id HAVING count(*) > 1)) AS repeated_ids,
  (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM m WHERE doc_id NOT IN (SELECT doc_id FROM n)) AS matches_without_notice, (SELECT count(DISTINCT doc_id) FROM n WHERE lang IN ('en', 'de')) AS indexed,
  (SELECT count(*) FROM b WHERE NOT empty AND lang NOT IN ('en', 'de')) AS not_indexed, 0::BIGINT AS indexed_without_notice"""


def table() -> dict:
    q = {
        "store_merged": (merged, MERGED_SQL),
        "store_upserted": (upserted, UPSERTED_SQL),
        "index_updated": (index_updated, WORDS_SQL + "SELECT doc_id FROM t WHERE lang = 'de' OR (lang <> 'fr' AND contains(w, ' on the '))"),
        "index_search": (searched, SEARCHED_SQL),
        "evaluation_stored": (evaluated, EVALUATED_SQL),
        "evaluation_passes": (evaluation_log, LOG_SQL),
        "preview_summary": (preview, PREVIEW_SQL),
        "stored_checks": (checks, CHECKS_SQL),
        "stream_keyed_state": (
            lambda s, d: keyed.run_once(s, changes.events_stream(s, d)),
            """WITH x AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) * 1000 + event_id % 1000 AS seq, event_type AS fingerprint FROM events),
y AS (SELECT *, lag(fingerprint) OVER (PARTITION BY key ORDER BY seq) AS was FROM x) SELECT key, seq, fingerprint, CASE WHEN was IS NULL THEN 'nueva' WHEN was = fingerprint THEN 'igual' ELSE 'actualizada' END AS outcome FROM y""",
        ),
    }
    for name, (ask, where) in ASKED.items():
        q[name] = (lambda s, d, f=ask: f(indexed(s, d)).withColumnRenamed("id", "doc_id"), WORDS_SQL + f"SELECT doc_id FROM t WHERE {where}")
    return q

"""Embedding near-duplicates by a flat graph with robust pruning, built on overlapping shards.

1. Equal vectors of a label become one. A bounded hash sample of them gives the centres of clusters; of centres that are near
   copies of each other one stays, so that a large group of near copies isn't dealt out.
2. Each vector goes to the shards of its nearest centres, so shards overlap; large shards have centres of their own. In each
   shard a graph is built by insertion: a vector's candidates are the nearest of those that the graph has so far, and robust
   pruning keeps those that no kept neighbour is much nearer to.
3. In each shard every member is searched for from itself: its neighbours in range are found, and the range expands from
   what is in range. That tells which members link with anything.
4. Members with links are compared in the shards that they share, by cosines in double precision; a pair counts in the first
   of its shards, so that no pair is listed.
5. A bounded sample is held against all rows, in blocks. If recall is below the aim, shards overlap more; if it is still
   below it with the largest overlap, all vectors of a label are compared, in blocks. Large labels of which the sample
   shows that a vector is linked to a hundredth or more of all are compared so from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.components import connect
from bidlens.session import prepare

LEAST_COSINE = 0.93
#: Vectors to a centre, about, as long as MAX_CENTRES allows; and centres of all labels together, about (they are broadcast).
SHARD = 400
MAX_CENTRES = 4_096
#: Shards that a vector is in at first; neighbours of a vector in the graph; nearest that are candidates; pruning factor.
OVERLAP, DEGREE, POOL, ALPHA = 3, 16, 32, 1.2
#: Edges of a vector to others drawn among its candidates; vectors of which the first graph is made.
LONGER, FIRST = 8, 64
#: Rows that a step of numpy takes together.
AT_ONCE = 512
#: Members of a shard, about; what is larger gets centres of its own, and what still is becomes several, one for each two of its blocks.
LARGEST = 3_000
#: Rows of a large shard that a task deals to its centres, about.
DEALT = 20_000
#: Queries of the audit, and the recall that it asks for.
AUDIT, RECALL = 400, 0.98
#: A label is dense if a vector is linked to this share of it, or more, on average.
DENSE = 0.01


# In a shard: x holds unit vectors, one a row; dots the products of each two of them


def _nearest_first(dots: np.ndarray, rows: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (-1: none) and their distances to the rows, in order; each only once, never the row itself."""
    c = np.sort(cand, axis=1)
    d = 2 - 2 * dots[rows[:, None], c]
    d[(c < 0) | (c == rows[:, None])] = np.inf
    d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    return np.where(np.isinf(d), -1, c), d


def robust_prune(dots: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Per row up to ``degree`` candidates: the nearest left is taken, and those go that it is alpha times nearer to than the row is."""
    if len(rows) > AT_ONCE:
        return np.concatenate([robust_prune(dots, rows[k : k + AT_ONCE], cand[k : k + AT_ONCE], degree, alpha) for k in range(0, len(rows), AT_ONCE)])
    c, d = _nearest_first(dots, rows, cand)
    left = ~np.isinf(d)
    nearer = 1 - d / (2 * alpha)  # the product from which a candidate is alpha times nearer to another
    out = np.full((len(rows), degree), -1)
    n = np.arange(len(rows))
    for k in range(degree):
        first = np.argmax(left, axis=1)
        live = left[n, first]
        if not live.any():
            break
        star = c[n, first]
        out[live, k] = star[live]
        left &= dots.take(star[:, None] * len(dots) + c, mode="clip") < nearer
        left[n, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, longer: int = LONGER, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency, a row for each vector, -1 where there are fewer. Vectors are inserted in random order, as many at a time as the graph has.

    A new vector's candidates are the ``pool`` nearest of the graph so far and of those that come with it; the pruned ones become its edges. In a tight
    group of many near copies pruning leaves few edges, so ``longer`` more are drawn among the candidates. Edges go both
    ways: where a vector has no room left for those of new ones, all of its are pruned again. The products of all vectors
    are held, which suits a shard: a greedy search for the candidates would meet ``pool`` times the edges of a vector, more than a shard has.
    """
    n = len(x)
    draw = np.random.default_rng(n)
    order = draw.permutation(n)
    x = x[order]  # from here on a row is the place in this order
    dots = x @ x.T
    most = 2 * (degree + longer)
    graph = np.full((n, most), -1)
    filled = np.zeros(n, np.int64)
    done = 0
    while done < n:
        there = done + (min(FIRST, n) if done == 0 else min(done, AT_ONCE, n - done))
        rows = np.arange(done, there)
        met = np.argpartition(-dots[done:there, :there], min(pool, there - 1), axis=1)[:, : pool + 1]
        near = robust_prune(dots, rows, met, degree, alpha)
        drawn = np.take_along_axis(met, draw.integers(0, met.shape[1], (len(rows), longer)), 1)
        new = np.sort(np.concatenate([near, drawn], axis=1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[new == rows[:, None]] = -1
        new = np.sort(new, axis=1)[:, ::-1]
        graph[rows, : new.shape[1]] = new
        filled[rows] = (new >= 0).sum(1)
        _link_back(dots, graph, filled, np.repeat(rows, (new >= 0).sum(1)), new[new >= 0], draw, degree, alpha)
        done = there
    out = np.empty_like(graph)
    out[order] = np.where(graph < 0, -1, order[graph])
    return out


def _link_back(dots: np.ndarray, graph: np.ndarray, filled: np.ndarray, source: np.ndarray, target: np.ndarray, draw: np.random.Generator, degree: int, alpha: float) -> None:
    """The edges ``source`` to ``target`` the other way, too."""
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    known = (graph[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    first = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1])
    place = filled[target] + np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate([first, [len(target)]])))
    fits = place < graph.shape[1]
    graph[target[fits], place[fits]] = source[fits]
    np.maximum.at(filled, target[fits], place[fits] + 1)
    full, times = np.unique(target[~fits], return_counts=True)
    if len(full):
        more = np.full((len(full), times.max()), -1)
        more[np.repeat(np.arange(len(full)), times), np.concatenate([np.arange(t) for t in times])] = source[~fits]
        every = np.concatenate([graph[full], more], axis=1)
        kept = robust_prune(dots, full, every, degree, alpha)
        some = np.take_along_axis(every, np.argsort(np.where(every < 0, 2, draw.random(every.shape)), axis=1)[:, : graph.shape[1] - degree], 1)
        both = np.sort(np.concatenate([kept, some], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        graph[full] = np.sort(both, axis=1)[:, ::-1]
        filled[full] = (graph[full] >= 0).sum(1)


def range_search(x: np.ndarray, graph: np.ndarray, most: float) -> list[np.ndarray]:
    """For each row those within the squared distance ``most`` that the search meets, itself included.

    It starts from the row. The neighbours of what is in range are tried until nothing new is in range.
    """
    n, found = len(x), []
    for k in range(0, n, AT_ONCE):
        near = graph[k : k + AT_ONCE]
        hit = (near >= 0) & (2 - 2 * np.einsum("nd,nmd->nm", x[k : k + AT_ONCE], x[near]) <= most)
        for r, edge in zip(range(k, k + len(near)), [e[h] for e, h in zip(near, hit, strict=True)], strict=True):
            if not len(edge):
                found.append(np.array([r]))
                continue
            left = 2 - 2 * (x @ x[r]) <= most
            there = left.copy()
            left[r] = left[edge] = False
            while len(edge):
                tried = np.zeros(n + 1, bool)
                tried[graph[edge]] = True  # the last place takes -1
                edge = np.flatnonzero(tried[:n] & left)
                left[edge] = False
            found.append(np.flatnonzero(there & ~left))
    return found


# On Spark


def fitted(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label and v of all rows; v is null for rows that link with nothing. Floats stay floats, all else is doubles; no zero is negative."""
    kind = vectors.schema[embedding].dataType
    one = kind.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    base = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(T.ArrayType(one)).alias("v"))
    most, least = F.array_max("v"), F.array_min("v")  # NaN is above all numbers
    finite = ~F.exists("v", lambda x: x.isNull()) & ~F.isnan(most) & (most < float("inf")) & (least > float("-inf"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & ((most > 0) | (least < 0))
    return base.select("id", "label", F.when(fit, F.transform("v", lambda x: x + F.lit(0.0).cast(one))).alias("v"))


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _apart(centres: np.ndarray, least: float) -> np.ndarray:
    """Places of the centres, without those whose cosine to an earlier one that stays is ``least`` or more. Linked vectors then have nearly the same nearest centres."""
    kept: list[int] = []
    held = np.empty_like(centres)
    for k, c in enumerate(centres):
        if not kept or (held[: len(kept)] @ c).max() < least:
            held[len(kept)] = c
            kept.append(k)
    return np.array(kept, np.int64)


def centres_of(classes: DataFrame, shard: int = SHARD, most: int = MAX_CENTRES, least: float = LEAST_COSINE) -> dict[tuple[str, int], np.ndarray]:
    """Centres by label and length of the vectors: a hash sample of the classes, one for ``unit`` of them, less those near to others.

    ``unit`` is ``shard``, and more if there would be over ``most`` centres. Labels of up to ``unit`` classes need none, so
    that about twice ``most`` vectors come to the driver at most, whatever the number of labels and rows.
    """
    n = classes.count()
    unit = max(shard, -(-n // most))
    sized = classes.withColumn("dims", F.size("v"))
    large = sized.groupBy("label", "dims").agg(F.count("*").alias("of"), F.min(F.xxhash64("id")).alias("first")).where(F.col("of") > unit)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit((1 << 40) // unit)
    rows = sized.join(large, ["label", "dims"]).where(drawn | (F.xxhash64("id") == F.col("first"))).select("id", "label", "v").toPandas().sort_values("id")
    if rows.empty:
        return {}
    every = {(label, int(dims)): _units(part["v"]) for (label, dims), part in rows.groupby([rows["label"], rows["v"].map(len)])}
    return {k: c[_apart(c, least)] for k, c in every.items()}


def assign(classes: DataFrame, centres: dict, overlap: int) -> DataFrame:
    """id and shard, a row for each class and shard of it. A label without centres is one shard."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            for (label, dims), part in rows.groupby([rows["label"], rows["v"].map(len)]):
                c = sent.value.get((label, int(dims)), np.zeros((1, dims)))
                k = min(overlap, len(c))
                best = np.argsort(-(_units(part["v"]) @ c.T), axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), k), "shard": [f"{len(label)}:{label}/{dims}/{i}" for i in best.ravel().tolist()]})

    kinds = T.StructType([classes.schema["id"], T.StructField("shard", T.StringType())])
    return classes.select("id", "label", "v").mapInPandas(near, kinds)


def refine(placed: DataFrame, classes: DataFrame, overlap: int, least: float = LEAST_COSINE, largest: int | None = None, most: int | None = None) -> DataFrame:
    """``placed`` (id, shard) with each shard of over ``largest`` dealt again, by centres that are drawn from it.

    A large shard is dealt by several tasks, each of about ``DEALT`` of its rows and all of its centres, ``most`` at most. A
    centre has one shard, whichever large shards it and its members are in, and of the centres of all large shards that a
    class is in its nearest ``overlap`` count, so that classes aren't dealt ``overlap`` times ``overlap`` times.
    """
    largest, most = LARGEST if largest is None else largest, MAX_CENTRES if most is None else most
    big = placed.groupBy("shard").agg(F.count("*").alias("of")).where(F.col("of") > largest).checkpoint()
    if big.isEmpty():
        return placed
    rows = placed.join(big, "shard").join(classes.select("id", "v"), "id").withColumn("tasks", F.ceil(F.col("of") / DEALT).cast("int"))
    unit = F.greatest(F.least(F.lit(SHARD), F.floor(F.col("of") / 8)), F.ceil(F.col("of") / most)).cast("long")
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), unit) == 0).select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "id", "v").toDF("of_shard", "of_task", "at", "v")
    dealt = rows.select("shard", F.pmod(F.xxhash64("id", F.lit(6)), F.col("tasks")).cast("int").alias("task"), "id", "v")

    def deal(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.assign(cos=0.0)[["id", "shard", "cos"]]
        if centres.empty:
            return own.assign(shard=own["shard"] + "|0", cos=1.0)[["id", "shard", "cos"]]
        centres = centres.sort_values("at")
        c = _units(centres["v"])
        kept = _apart(c, least)
        c, names = c[kept], own["shard"].iloc[0].rpartition("/")[0] + "|" + centres["at"].to_numpy()[kept].astype(str).astype(object)
        out = []
        for k in range(0, len(own), AT_ONCE):
            cos = _units(own["v"].iloc[k : k + AT_ONCE]) @ c.T
            best = np.argsort(-cos, axis=1, kind="stable")[:, :overlap]
            out.append(pd.DataFrame({"id": np.repeat(own["id"].to_numpy()[k : k + AT_ONCE], best.shape[1]), "shard": names[best.ravel()], "cos": np.take_along_axis(cos, best, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    kinds = T.StructType([*placed.select("id", "shard").schema, T.StructField("cos", T.DoubleType())])
    again = dealt.groupBy("shard", "task").cogroup(drawn.groupBy("of_shard", "of_task")).applyInPandas(deal, kinds)
    nearest = F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("far"), "shard")))
    again = again.repartition("id").groupBy("id", "shard").agg(F.max("cos").alias("cos")).groupBy("id").agg(F.slice(nearest, 1, overlap)["shard"].alias("shards"))
    return placed.join(big, "shard", "left_anti").select("id", "shard").union(again.select("id", F.explode("shards"))).checkpoint()


def split(placed: DataFrame, largest: int | None = None) -> DataFrame:
    """``placed`` (id, shard) with shards of over ``largest`` cut into blocks, each two of which are a shard; and ``shards``, all of the class."""
    largest = LARGEST if largest is None else largest
    sizes = placed.groupBy("shard").agg(F.count("*").alias("of"))
    blocks = F.when(F.col("of") > largest, F.ceil(2 * F.col("of") / largest)).otherwise(1).cast("int")
    cut = placed.join(sizes, "shard").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (F.col("blocks") == 1) | (b != F.col("own")))
    name = lambda b: F.when(F.col("blocks") == 1, F.col("shard")).otherwise(F.concat_ws("/", "shard", F.least("own", b).cast("string"), F.greatest("own", b).cast("string")))
    all_of = cut.select("id", F.transform(others, name).alias("names")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("shards"))
    return all_of.select("id", "shards", F.explode("shards").alias("shard"))


def _linked_in(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Ids of a shard's members that a search in its graph finds a link of; both of the link."""
    exact = _units(rows["v"])
    x = exact.astype(np.float32)
    found = range_search(x, build(x), 2 - 2 * least + 1e-4)
    one, two = np.repeat(np.arange(len(rows)), [len(js) for js in found]), np.concatenate(found)
    one, two = one[one != two], two[one != two]
    linked = np.zeros(len(rows), bool)
    for k in range(0, len(one), 1 << 16):
        i, j = one[k : k + (1 << 16)], two[k : k + (1 << 16)]
        left = ~(linked[i] & linked[j])
        i, j = i[left], j[left]
        ok = np.einsum("nd,nd->n", exact[i], exact[j]) >= least
        linked[i[ok]] = linked[j[ok]] = True
    return rows.loc[linked, ["id"]]


def _links(hit: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Of a matrix of links: per member that has any the rows in range, and one member that these links reach."""
    some = np.flatnonzero(hit.any(1))
    hit, ids, n = hit[np.ix_(some, some)], ids[some], n[some]
    part = np.arange(len(ids), dtype=np.int32)
    links = np.zeros(len(ids), np.int64)
    for k in range(0, len(ids), AT_ONCE):
        links[k : k + AT_ONCE] = np.where(hit[k : k + AT_ONCE], n[None, :], 0).sum(1)
    while len(part):
        least_of = np.concatenate([np.where(hit[k : k + AT_ONCE], part[None, :], len(part)).min(1) for k in range(0, len(part), AT_ONCE)]).astype(np.int32)
        new = np.minimum(part, least_of)
        new = new[new]
        if (new == part).all():
            break
        part = new
    return pd.DataFrame({"id": ids, "links": links, "hub": ids[part]})


def _count_shard(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links among the members given; a pair that a shard earlier by name has, too, counts there."""
    x, own = _units(rows["v"]), rows["shard"].iloc[0]
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    at = np.repeat(np.arange(len(rows)), rows["shards"].map(len))
    names = np.concatenate(rows["shards"].to_numpy())
    for both in pd.Series(at[names < own]).groupby(names[names < own]).indices.values():
        if len(both) > 1:
            there = at[names < own][both]
            hit[np.ix_(there, there)] = False
    return _links(hit, rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64))


def _found_kinds(classes: DataFrame) -> T.StructType:
    return T.StructType([classes.schema["id"], T.StructField("links", T.LongType()), T.StructField("hub", classes.schema["id"].dataType)])


def search(classes: DataFrame, overlap: int, least: float = LEAST_COSINE) -> DataFrame:
    """id, links (rows in linked classes), hub (a class of the same component): several rows for one id, links to be summed."""
    placed = split(refine(assign(classes, centres_of(classes, least=least), overlap).checkpoint(), classes, overlap, least)).checkpoint()
    members = placed.select("id", "shard").join(classes.select("id", "v"), "id").groupBy("shard")
    linked = members.applyInPandas(lambda rows: _linked_in(rows, least), T.StructType([classes.schema["id"]])).distinct().checkpoint()
    again = placed.join(linked, "id", "left_semi").join(classes.select("id", "n", "v").join(linked, "id", "left_semi"), "id")
    return again.groupBy("shard").applyInPandas(lambda rows: _count_shard(rows, least), _found_kinds(classes))


def _compare_blocks(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between two blocks, or within one. No pair is listed."""
    rows = rows.sort_values("block", ignore_index=True)
    x, first = _units(rows["v"]), int((rows["block"] == rows["block"].iloc[0]).sum())
    hit = np.zeros((len(rows), len(rows)), bool)
    if rows["block"].iloc[0] == rows["other"].iloc[0]:
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
    else:
        hit[:first, first:] = x[:first] @ x[first:].T >= least
        hit[first:, :first] = hit[:first, first:].T
    return _links(hit, rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64))


def compare_all(classes: DataFrame, least: float = LEAST_COSINE, largest: int | None = None) -> DataFrame:
    """As ``search``, without a graph: all classes of a label and length are compared, two blocks of them in a task."""
    largest = LARGEST if largest is None else largest
    named = classes.select(F.concat_ws("/", "label", F.size("v").cast("string")).alias("shard"), "id", "n", "v")
    sizes = named.groupBy("shard").agg(F.count("*").alias("of"))
    cut = named.join(sizes, "shard").withColumn("blocks", F.ceil(2 * F.col("of") / largest).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = cut.withColumn("other", other).select(F.concat_ws("/", "shard", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")).alias("shard"), "block", "other", "id", "n", "v")
    return each.groupBy("shard").applyInPandas(lambda rows: _compare_blocks(rows, least), _found_kinds(classes))


def truth(classes: DataFrame, least: float = LEAST_COSINE, queries: int = AUDIT) -> DataFrame:
    """For a bounded hash sample of classes: id, label and ``there``, the rows linked to it, by comparing with all rows."""
    asked = classes.orderBy(F.xxhash64("id", F.lit(7))).limit(queries).select("id", "label", "v").toPandas()
    sent = classes.sparkSession.sparkContext.broadcast([(k, part["id"].to_numpy(), _units(part["v"])) for k, part in asked.groupby([asked["label"], asked["v"].map(len)])] if len(asked) else [])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            groups = dict(list(rows.groupby([rows["label"], rows["v"].map(len)])))
            for k, ids, q in sent.value:
                if k in groups:
                    part = groups[k]
                    hit = (q @ _units(part["v"]).T >= least) & (ids[:, None] != part["id"].to_numpy()[None, :])
                    yield pd.DataFrame({"id": ids, "label": k[0], "there": hit @ part["n"].to_numpy().astype(np.int64), "partners": hit.sum(1)})

    kinds = T.StructType([classes.schema["id"], T.StructField("label", T.StringType()), T.StructField("there", T.LongType()), T.StructField("partners", T.LongType())])
    return classes.select("id", "label", "v", "n").mapInPandas(compare, kinds).groupBy("id", "label").agg(F.sum("there").alias("there"), F.sum("partners").alias("partners")).checkpoint()


def missed(there: DataFrame, found: DataFrame, recall: float = RECALL) -> DataFrame:
    """The labels of which fewer of the links that ``truth`` has are found than ``recall``."""
    both = there.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    of = both.groupBy("label").agg(F.sum("there").alias("there"), F.sum(F.coalesce("links", F.lit(0))).alias("found"))
    return of.where(F.col("found") < recall * F.col("there")).select("label")


def audit(there: DataFrame, found: DataFrame) -> float:
    """Recall over all labels: links found of those that ``truth`` has."""
    both = there.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").agg(F.sum("there"), F.sum(F.coalesce("links", F.lit(0)))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id and kept.

    Linked are rows of equal label, not null, whose cosine is ``least`` or more. Null and zero vectors, those with
    null or non-finite components and null labels link with nothing, nor do vectors of different lengths; a null id
    neither. Such rows are components of their own. Rows with equal vectors are one class for the search; their links to
    each other count. Ids are taken to be unique; a repeated id counts as another vector.
    """
    prepare(vectors.sparkSession)
    rows = fitted(vectors, vec_id, embedding, label)
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).checkpoint()
    there = truth(classes, least)
    sizes = classes.groupBy("label").agg(F.count("*").alias("of")).where(F.col("of") > 2 * SHARD)
    dense = there.groupBy("label").agg(F.avg("partners").alias("partners")).join(sizes, "label").where(F.col("partners") >= DENSE * F.col("of")).select("label").checkpoint()
    rest, parts_found, overlap = classes, [], OVERLAP
    if not dense.isEmpty():
        rest, there = classes.join(dense, "label", "left_anti").select(classes.columns).checkpoint(), there.join(dense, "label", "left_anti")
        parts_found.append(compare_all(classes.join(dense, "label", "left_semi").select(classes.columns), least))
    while True:
        found = search(rest, overlap, least).checkpoint()
        again = missed(there, found).checkpoint()
        if again.isEmpty():
            parts_found.append(found)
            break
        # labels that were found well enough are done; only the others are searched with more overlap, at last in blocks
        left = rest.join(again, "label", "left_semi").select(classes.columns).checkpoint()
        parts_found.append(found.join(left.select("id"), "id", "left_anti").select(found.columns))
        rest, there = left, there.join(again, "label", "left_semi")
        if overlap >= 4 * OVERLAP:
            parts_found.append(compare_all(rest, least))
            break
        overlap *= 2
    found = reduce(DataFrame.union, parts_found).checkpoint()
    parts = connect(found.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")), "a", "b")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = counted.join(parts, "id", "left").select(F.col("id").alias("class"), "links", "component")
    copies = classes.where("n > 1").select("label", "v", F.col("id").alias("class"), "n")
    if copies.isEmpty():
        of_class = rows.select("id", F.expr("if(v is null, null, id)").alias("class"), F.lit(1).alias("n"))
    else:
        of_class = rows.join(copies, ["label", "v"], "left").select("id", F.expr("if(v is null, null, coalesce(class, id))").alias("class"), F.coalesce("n", F.lit(1)).alias("n"))
    both = of_class.join(linked, "class", "left")
    component = F.coalesce("component", "class", "id").cast("long")
    links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return both.select(F.col("id").alias(vec_id), links.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_embedding_graph(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP10_SQL = """
WITH RECURSIVE clean AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

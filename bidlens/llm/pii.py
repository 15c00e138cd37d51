"""Personal data: patterns, and a skip-chain conditional random field that carries their labels through a document.

Nodes are the words that have a digit or an @; all other words are known to be outside. A node has a potential from its
form. Neighbouring words are joined by chain edges, and words of equal or similar content, however far apart, by skip
edges: equal but for punctuation and case, the same last seven digits, the part of an address before its @, the last four
digits of a long number. What a pattern has found is observed. Loopy message passing then labels the other nodes: a
number that was written in full once is known where it stands in part, too.

The potentials are fitted piece by piece on a bounded sample, whose labels are those of the patterns. A node that no
pattern has found, though it is joined by a skip edge to one that a pattern has, counts as unknown there, not as outside.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as chained_lists

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.text import unused, whole
from bidlens.session import prepare

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside, label k + 1 is KINDS[k].
LABELS = len(KINDS) + 1

#: Documents in the sample that potentials are fitted on, about. A bound of the fit alone.
FIT_DOCUMENTS = 20_000
#: Skip edges that agree and that don't, as many as are taken to have been seen before the sample.
AGREEING = np.array([19.0, 1.0])
#: A node is reported from this marginal probability on.
CONFIDENT = 0.9
ROUNDS, DAMPING, SETTLED = 30, 0.5, 1e-4
#: Edges whose sums over labels are made at a time.
EDGES = 50_000
#: Characters whose graph is solved together.
CHUNK_CHARS = 4_000_000

#: The base patterns. Look-behinds and possessive repeats only spare attempts that can't succeed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

ANY = re.compile(r"[0-9@]")
NODE = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+")
OTHER_THAN_CONTENT = re.compile(r"[\W_]+")
ASCII_SPACE = re.compile(r"[ \t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one @, with all that it may begin with before it; so it is sought from the @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def octet(digits: str) -> bool:
    """Whether a number, with any zeros before it, is at most 255."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind, then start. In code points."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Nodes and their form


def core(word: str) -> tuple[int, int]:
    """Start and end of the word without punctuation around it; a leading + or ( of a number stays."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum() and not (word[a] in "+(" and a + 1 < b and word[a + 1].isdigit()):
        a += 1
    while b > a and not word[b - 1].isalnum() and not (word[b - 1] == ")" and "(" in word[a:b]):
        b -= 1
    return a, b


def form(word: str) -> list[int]:
    """Numbers of the features that the core of a word has, below FEATURES."""
    word = word[slice(*core(word))]
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    parts = word.split(".")
    dotted = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    out = [0, 1 + next(k for k, most in enumerate((0, 1, 3, 4, 7, 9, 12, 15, 19, 1 << 62)) if digits <= most)]
    named, _, place = word.partition("@")
    checks = (
        letters == 0,
        letters > digits,
        0 < letters <= digits,
        "@" in word,
        bool(named and place) and "." in place.strip("."),
        "." in word,
        dotted,
        dotted and all(map(octet, parts)),
        word.startswith("+"),
        "(" in word or ")" in word,
        "-" in word,
        ":" in word or "/" in word,
        16 <= digits <= 19 and letters == 0 and luhn("".join(c for c in word if c in "0123456789")),
    )
    return out + [11 + k for k, ok in enumerate(checks) if ok]


FEATURES = 24


def nodes_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[int]]:
    """Base spans, the places of the nodes, and each node's label by the spans (0 where none touches it)."""
    if not ANY.search(text):
        return [], [], []
    base = base_spans(text)
    places = [m.span() for m in NODE.finditer(text)]
    labels = [0] * len(places)
    starts = np.array([a for a, _ in places], np.int64)
    for kind, a, b in reversed(base):  # of spans that overlap, the kind listed first
        k = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        while k < len(places) and places[k][0] < b:
            if places[k][1] > a:
                labels[k] = kind + 1
            k += 1
    return base, places, labels


def keys_of(word: str) -> list[str]:
    """What a node is told by, the whole content first; nodes that share one are joined. Contents of under four characters tell nothing."""
    content = OTHER_THAN_CONTENT.sub("", word).lower()
    if content.lstrip("x").isdecimal():  # a masked number
        content = content.lstrip("x")
    out = [content] if len(content) >= 4 else []
    named, at, _ = word.partition("@")
    local = OTHER_THAN_CONTENT.sub("", named).lower()
    if at and len(local) >= 4:
        out.append(local)
    if content.isdecimal() and len(content) > 7:
        out.append(content[-7:])
    if content.isdecimal() and len(content) >= 13:
        out.append(content[-4:])
    return out


@dataclass
class Graph:
    """Nodes of one or more documents, without an edge between those of different documents. ``like`` marks skip edges of similar content.

    ``forms`` has each node's features as bits.
    """

    forms: np.ndarray
    labels: np.ndarray
    outside: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    like: np.ndarray | None = None

    def likes(self) -> np.ndarray:
        return np.zeros(len(self.skip), bool) if self.like is None else self.like

    def parts(self) -> np.ndarray:
        """For each node the least node that edges reach from it."""
        least = np.arange(len(self.labels))
        a, b = np.concatenate([self.chain, self.skip]).T
        while len(a):
            x, y = least[a], least[b]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (least[least] != least).any():
                least = least[least]
            if (least[a] == least[b]).all():
                break
        return least

    def unknown(self) -> np.ndarray:
        """Nodes without a label that a skip edge joins to one with a label."""
        out = np.zeros(len(self.labels), bool)
        seen = self.labels > 0
        if len(self.skip):
            a, b = self.skip.T
            np.logical_or.at(out, a, seen[b])
            np.logical_or.at(out, b, seen[a])
        return out & ~seen


def graph_of(texts: list[str], places: list[list[tuple[int, int]]], labels: list[list[int]]) -> Graph:
    forms, outside, chain, skip, like, n = array("q"), array("b"), array("q"), array("q"), array("b"), 0
    for text, at in zip(texts, places, strict=True):
        last: dict[str, int] = {}
        end = len(text)
        for k, (a, b) in enumerate(at):
            word = text[a:b]
            forms.append(sum(1 << f for f in form(word)))
            joined = k > 0 and bool(ASCII_SPACE.fullmatch(text, at[k - 1][1], a))
            if joined:
                chain.extend((n + k - 1, n + k))
            following = k + 1 < len(at) and bool(ASCII_SPACE.fullmatch(text, b, at[k + 1][0]))
            outside.append((not joined and a > 0) + (not following and b < end))
            met = set()
            for which, key in enumerate(keys_of(word)):
                if key in last and last[key] not in met:
                    other = text[slice(*at[last[key] - n])]
                    met.add(last[key])
                    skip.extend((last[key], n + k))
                    like.append(which > 0 or keys_of(other)[0] != key)
                last[key] = n + k
        n += len(at)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    flat = np.fromiter(chained_lists.from_iterable(labels), np.int64, len(forms))
    return Graph(np.array(forms), flat, np.array(outside, np.float64), pairs(chain), pairs(skip), np.array(like, bool))


# The model


@dataclass
class Model:
    """Potentials (logarithms): of forms and labels, of neighbouring labels, and of labels across a skip edge of equal or of similar content."""

    form: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    like: np.ndarray | None = None

    def unary(self, g: Graph) -> np.ndarray:
        forms, of = np.unique(g.forms, return_inverse=True)
        bits = (forms[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)
        return (bits @ self.form)[of.reshape(-1)] + g.outside[:, None] * self.chain[0]


def fit(features: np.ndarray, labels: np.ndarray, times: np.ndarray, chain: np.ndarray, outside: np.ndarray, agree: np.ndarray, steps: int = 300, decay: float = 1e-3) -> Model:
    """Piecewise: the forms by logistic regression, the chain by how much more often than by chance labels meet, skips by how often two labels of patterns agree.

    An edge that agrees gains what a label is rarer than that, so that a rare kind is carried as well as a frequent one.
    Rows of ``features`` with their labels are distinct; ``times`` is how often each occurs. ``chain`` counts pairs of
    neighbouring labels; ``outside`` counts, for each label, neighbours that are no nodes. ``agree`` counts skip edges
    between two labels of patterns: in row 0 those of equal content, in row 1 of similar; those that agree, those that don't.
    """
    w = np.zeros((FEATURES, LABELS))
    if len(labels):
        weight = times / times.sum()
        truth = np.eye(LABELS)[labels]
        velocity = np.zeros_like(w)
        for _ in range(steps):
            z = features @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            velocity = 0.9 * velocity - 1.0 * (features.T @ ((p - truth) * weight[:, None]) + decay * w)
            w += velocity
    counts = chain + chain.T + 1.0
    counts[0] += outside
    counts[:, 0] += outside
    joint = counts / counts.sum()
    alone = joint.sum(1)
    meet = np.log(joint / alone[:, None] / alone[None, :])
    share = (np.bincount(labels, times, LABELS) + 1) / (times.sum() + LABELS)
    tables = []
    for same, other in agree + AGREEING:
        r = same / (same + other)
        table = np.full((LABELS, LABELS), np.log(1 - r))
        table[np.diag_indices(LABELS)] = np.log(r / share)
        table[0, 0] = 0
        tables.append(np.clip(table, -6, 8))
    return Model(w, np.clip(meet, -3, 3), *tables)


def marginals(model: Model, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the labels by loopy sum-product message passing, damped; labels found by patterns are observed.

    Each connected part settles for itself, so what else is solved beside it changes nothing. Room grows with the
    nodes and edges, by some numbers for each; the sums over labels are made some edges at a time.
    """
    n = len(g.labels)
    own = model.unary(g)
    seen = g.labels > 0
    own[seen] = -50.0
    own[seen, g.labels[seen]] = 0.0
    own -= own.max(1, keepdims=True)
    edges = np.concatenate([g.chain, g.skip])
    if not len(edges):
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    kind_of = np.tile(np.concatenate([np.zeros(len(g.chain), np.int64), 1 + g.likes()]), 2)
    tables = np.stack((model.chain, model.skip, model.skip if model.like is None else model.like))
    message = np.zeros((len(source), LABELS))
    part_of = g.parts()[source]
    live = np.arange(len(source))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, message)
        new = np.empty((len(live), LABELS))
        for k in range(0, len(live), EDGES):
            e = live[k : k + EDGES]
            z = (belief[source[e]] - message[back[e]])[:, :, None] + tables[kind_of[e]]
            top = z.max(1, keepdims=True)
            new[k : k + EDGES] = (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]
        new -= new.max(1, keepdims=True)
        moved = np.zeros(n)
        np.maximum.at(moved, part_of[live], np.abs(new - message[live]).max(1))
        message[live] = DAMPING * message[live] + (1 - DAMPING) * new
        live = live[moved[part_of[live]] >= SETTLED]
        if not len(live):
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True)).reshape(n, LABELS)


def label(model: Model, texts: list[str], confident: float = CONFIDENT) -> list[list[tuple[int, int, int, bool]]]:
    """Per text (kind, start, end, base) of all spans, by kind, then start."""
    found = [nodes_of(t) for t in texts]
    out: list[list[tuple[int, int, int, bool]]] = [[(*s, True) for s in base] for base, _, _ in found]
    open_ = [k for k, (base, places, labels) in enumerate(found) if places and not all(labels)]
    if open_:
        g = graph_of([texts[k] for k in open_], [found[k][1] for k in open_], [found[k][2] for k in open_])
        p = marginals(model, g)
        best = np.where(p[:, 1:].max(1) >= confident, p[:, 1:].argmax(1) + 1, 0)
        best[g.labels > 0] = 0
        linked = np.zeros(len(best), bool)
        if len(g.chain):
            linked[g.chain[:, 1]] = True
        n = 0
        for k in open_:
            spans: list[list[int]] = []
            for i, (a, b) in enumerate(found[k][1]):
                if kind := int(best[n + i]):
                    x, y = core(texts[k][a:b])
                    if i and linked[n + i] and best[n + i - 1] == kind and spans:
                        spans[-1][2] = a + y
                    else:
                        spans.append([kind - 1, a + x, a + y])
            out[k] += [(*s, False) for s in spans]
            n += len(found[k][1])
    return [sorted(x) for x in out]


# On Spark


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document of the sample that has nodes: what the fit needs of it."""
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            _, places, labels = nodes_of(text)
            if places:
                g = graph_of([text], [places], [labels])
                known = ~g.unknown()
                a, b = (g.labels[e] for e in g.chain[known[g.chain].all(1)].T)
                x, y = (g.labels[e] for e in g.skip.T)
                both = (x > 0) & (y > 0)
                rows.append((key, g.forms[known].tolist(), g.labels[known].tolist(), g.outside[known].astype(np.int64).tolist(), (LABELS * a + b).tolist(), (2 * g.likes() + (x != y))[both].tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "form", "label", "outside", "chain", "skip"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = FIT_DOCUMENTS) -> Model:
    """A model from about ``documents`` documents, chosen by a hash of id and text, with all their nodes.

    What comes to the driver are distinct forms with their counts, whatever the number of nodes.
    The model depends on the rows alone, not on their order or partitions.
    """
    prepare(docs.sparkSession)
    n = docs.count()
    share = 1 << 40 if n <= documents else (1 << 40) * documents // n
    keyed = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), whole(text).alias("text"))
    sample = keyed.where(F.pmod("key", F.lit(1 << 40)) < share)
    schema = "key bigint, form array<bigint>, label array<bigint>, outside array<bigint>, chain array<bigint>, skip array<bigint>"
    rows = sample.mapInArrow(_evidence, schema)
    zero = F.lit(0).cast("bigint")
    coded = lambda what: F.transform(what, lambda x: F.struct(F.lit(what).alias("what"), x.alias("form"), zero.alias("label"), zero.alias("outside")))
    nodes = F.transform(F.arrays_zip("form", "label", "outside"), lambda x: F.struct(F.lit("node").alias("what"), x["form"].alias("form"), x["label"].alias("label"), x["outside"].alias("outside")))
    parts = rows.select(F.inline(F.flatten(F.array(nodes, coded("chain"), coded("skip"))))).groupBy("what", "form", "label", "outside").agg(F.count("*").alias("n"))
    forms: dict[tuple[int, int], int] = {}
    chain, outside, agree = np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros((2, 2))
    for what, code, y, free, count in sorted(map(tuple, parts.collect())):
        if what == "node":
            forms[code, y] = forms.get((code, y), 0) + count
            outside[y] += free * count
        elif what == "chain":
            chain[code // LABELS, code % LABELS] += count
        else:
            agree[code // 2, code % 2] += count
    features = np.array([[(code >> k) & 1 for k in range(FEATURES)] for code, _ in forms], np.float64).reshape(-1, FEATURES)
    return fit(features, np.array([y for _, y in forms], np.int64), np.array(list(forms.values()), np.float64), chain, outside, agree)


def _label_rows(batches: Iterator[pa.RecordBatch], source: str, model: Model, confident: float) -> Iterator[pa.RecordBatch]:
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    for batch in batches:
        texts = batch.column(source).to_pylist()
        kept = [c for c in batch.schema.names if c != source]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK_CHARS):
                size += len(texts[stop])
                stop += 1
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in label(model, texts[start:stop], confident)]
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(spans, kind_of)], [*kept, "spans"])
            start = stop


def find(docs: DataFrame, text: str = "text", model: Model | None = None, doc_id: str = "doc_id", confident: float = CONFIDENT) -> DataFrame:
    """``docs`` with the text replaced by ``spans``: array of kind, start, end (code points, end exclusive), base; by kind, then start.

    ``base`` tells what a pattern found from what the field adds. Without a ``model`` one is fitted on ``docs``. Null and
    empty texts have no spans; rows repeat as they are; other columns pass through; a column ``spans`` is replaced.
    An empty table gives an empty result. One document's graph is solved within one row: its edges grow with its words, and
    its connected parts are solved apart.
    """
    prepare(docs.sparkSession)
    model = train(docs, doc_id, text) if model is None else model
    rest = [c for c in docs.columns if c not in (text, "spans")]
    kind_of = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("spans", kind_of)])
    own = unused(docs, "_text")
    return docs.select(*rest, whole(text).alias(own)).mapInArrow(lambda it: _label_rows(it, own, model, confident), schema)


def op2_pii_skip_chain(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))

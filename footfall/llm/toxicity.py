"""Toxic spans by a linear-chain conditional random field over word evidence.

A bounded sample of labelled documents (``MOST_LABELLED`` per class, in hash order) teaches it. On two thirds of
the sample, words and word beginnings are counted in toxic and clean documents; a feature's evidence is the
lower confidence bound of its log odds. Tokens of toxic documents with evidence of at least ``TOXIC`` are the
labelled tokens. On the other third, the field (two tags; evidence classes of a token and its neighbours,
and the tag before) is fitted to those tokens by gradient ascent on the conditional likelihood, on at most
``FIELD_DOCUMENTS`` documents of each class in hash order, and, on all of that third, a logistic curve from marginals to document labels.

Every whole text is then tagged: forward-backward gives each token's marginal, these aggregate to the score,
and runs of tokens with a marginal of at least one half are the offending spans (byte offsets in UTF-8). Long
texts are cut into blocks whose transfer products are chained, which gives exactly the whole text's marginals.

Defined cases: a null or empty text has no tokens and gets the score of a text without evidence; repeated rows are
scored each; a document labelled more than once counts as toxic if any label says so, null labels are left out;
without toxic and clean labels every score is 0; documents with the same labels and hash are taken in the order of their ids; an empty table gives no rows. Only the text is an input of a
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.hashing import FINE, Words, lean, mix, slices, words

MOST_LABELLED = 6000
FIELD_DOCUMENTS = 500
PREFIXES = (4, 5, 6)
Z = 2.5
TOXIC = 1.0
EDGES = np.array([1e-9, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0])
CLASSES = len(EDGES) + 1
STEP = 64
ROUNDS = 150

U = np.uint64


def features(found: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings, one array per kind."""
    own = [found.hashes()]
    for length in PREFIXES:
        own.append(mix(found.hashes(length) + U(length)))
    return own


@dataclass
class Model:
    """Evidence by feature, the field's weights, and the curve from marginals to scores."""

    keys: np.ndarray
    evidence: np.ndarray
    emission: np.ndarray = field(default_factory=lambda: np.zeros((3, CLASSES)))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def classes(self, found: Words) -> np.ndarray:
        """Each token's strongest evidence, as a class."""
        best = np.zeros(len(found.starts))
        if len(self.keys):
            for hashes in features(found):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                best = np.maximum(best, np.where(self.keys[at] == hashes, self.evidence[at], 0.0))
        return np.digitize(best, EDGES)

    def odds(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of the toxic tag from a token's class and those of its neighbours in the text."""
        return self.emission[0][classes] + sum(
            np.where(there, self.emission[1 + k][near], 0.0) for k, (near, there) in enumerate(_neighbours(classes, first))
        )

    def score(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-summary(marginals, first) @ self.curve))


def _neighbours(classes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(classes)
    for shift, edge in ((1, first[:-1]), (-1, first[1:] - 1)):
        there = np.ones(n, bool)
        there[edge[np.diff(first) > 0]] = False
        yield np.roll(classes, shift), there


def summary(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's score is made from: its expected toxic tokens, the strongest one, their share."""
    n = np.diff(first)
    expected, strongest = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        expected[full] = np.add.reduceat(marginals, first[:-1][full])
        strongest[full] = np.maximum.reduceat(marginals, first[:-1][full])
    return np.stack([np.ones(len(n)), np.log1p(expected), strongest, np.log1p(1000 * expected / np.maximum(n, 1))], axis=1)


def marginals(odds: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic tag of every token, the expected tag pairs, and each text's log normaliser.

    Tags before a text are clean. Texts are padded to whole blocks of ``STEP`` tokens.
    """
    n = np.diff(first)
    blocks = -(-n // STEP)
    begin = np.concatenate(([0], np.cumsum(blocks)))
    total = int(begin[-1])
    place = np.arange(len(odds)) + np.repeat(begin[:-1] * STEP - first[:-1], n)
    psi = np.ones(total * STEP)
    psi[place] = np.exp(np.clip(odds, -30, 30))
    real = np.zeros(total * STEP, bool)
    real[place] = True
    psi, real = psi.reshape(total, STEP).T.copy(), real.reshape(total, STEP).T.copy()
    a = np.exp(transition)
    # Transfer product of each block, scaled to avoid overflow; padding changes nothing.
    prod = np.tile(np.eye(2), (total, 1, 1))
    scale = np.zeros(total)
    for t in range(STEP):
        new = prod @ a
        new[:, :, 1] *= psi[t][:, None]
        size = new.sum(axis=(1, 2))
        new /= size[:, None, None]
        prod = np.where(real[t][:, None, None], new, prod)
        scale += np.where(real[t], np.log(size), 0.0)
    into, back = np.zeros((total, 2)), np.ones((total, 2))
    log_z = np.zeros(len(n))
    state = np.tile([1.0, 0.0], (len(n), 1))
    for k in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > k)
        at = begin[live] + k
        into[at] = state[live]
        new = np.einsum("ij,ijk->ik", state[live], prod[at])
        size = new.sum(axis=1)
        state[live] = new / size[:, None]
        log_z[live] += np.log(size) + scale[at]
    state = np.ones((len(n), 2))
    for k in range(int(blocks.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(blocks > k)
        at = begin[live] + k
        back[at] = state[live]
        new = np.einsum("ijk,ik->ij", prod[at], state[live])
        state[live] = new / new.sum(axis=1)[:, None]
    forward = np.empty((STEP + 1, total, 2))
    forward[0] = into
    for t in range(STEP):
        new = forward[t] @ a
        new[:, 1] *= psi[t]
        new /= new.sum(axis=1)[:, None]
        forward[t + 1] = np.where(real[t][:, None], new, forward[t])
    toxic, pairs, beta = np.empty((STEP, total)), np.zeros((2, 2)), back
    for t in range(STEP - 1, -1, -1):
        both = forward[t + 1] * beta
        toxic[t] = both[:, 1] / both.sum(axis=1)
        ahead = beta * np.stack([np.ones(total), psi[t]], axis=1)
        joint = forward[t][:, :, None] * a * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2))[:, None, None]
        pairs += joint[real[t]].sum(axis=0)
        new = ahead @ a.T
        beta = np.where(real[t][:, None], new / new.sum(axis=1)[:, None], beta)
    return toxic.T.reshape(-1)[place], pairs, log_z


def fit_field(model: Model, classes: np.ndarray, first: np.ndarray, tags: np.ndarray) -> None:
    """Conditional likelihood of the tags by gradient ascent with momentum scaling (Adam)."""
    before = np.zeros_like(tags)
    before[1:] = tags[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (before, tags), 1)
    near = [(classes, np.ones(len(classes), bool)), *_neighbours(classes, first)]
    weights = np.zeros(3 * CLASSES + 4)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, ROUNDS + 1):
        model.emission, model.transition = weights[:-4].reshape(3, CLASSES), weights[-4:].reshape(2, 2)
        p, pairs, _ = marginals(model.odds(classes, first), first, model.transition)
        slope = [np.bincount(c[there], (tags - p)[there], CLASSES) for c, there in near]
        gradient = np.concatenate([*slope, (seen - pairs).ravel()]) / len(first) - 0.01 * weights
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        weights = weights + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.emission, model.transition = weights[:-4].reshape(3, CLASSES), weights[-4:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.05 * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curvature, slope), -3, 3)
    return w


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for begin, end in slices(batch.column(column), FINE):
            part = batch.slice(begin, end - begin)
            yield part, words(part.column(column))


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many documents of each kind a feature occurs, from ``toxic, text``."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _parts(batches, 1):
            n = np.diff(found.first)
            doc = np.repeat(np.arange(len(n)), n)
            label = part.column(0).to_numpy().astype(np.int64)
            for hashes in features(found):
                keys, local = np.unique(hashes, return_inverse=True)
                once = np.unique(doc * max(len(keys), 1) + local)
                toxic = label[once // max(len(keys), 1)]
                of = once % max(len(keys), 1)
                tox = np.bincount(of, toxic, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(tox), pa.array(np.bincount(of, minlength=len(keys)) - tox)],
                    names=["feature", "toxic", "clean"],
                )

    counted = sample.select("toxic", "text").mapInArrow(count, "feature long, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``MOST_LABELLED`` documents of each class; ``training`` is a condition on the id column."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), F.col(id_col))
    chosen = [
        known.filter(F.coalesce(training, F.lit(False)) & (F.col("toxic") == kind)).orderBy(order, id_col).limit(MOST_LABELLED)
        for kind in (1, 0)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(ids, id_col)
    third = F.pmod(F.xxhash64(F.lit("third"), F.col(id_col)), F.lit(3)) == 0
    evidence = sample.filter(~third)
    sizes = {r["toxic"]: r["count"] for r in evidence.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        model = Model(np.empty(0, U), np.empty(0))
        model.curve = np.array([-40.0, 0, 0, 0])
        return model
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (sizes[1] + 1.0)) - F.log(c / (sizes[0] + 1.0)) - Z * F.sqrt(1 / t + 1 / c)
    lexicon = feature_counts(evidence).filter("toxic >= 2").select("feature", odds.alias("e")).filter("e > 0").toArrow()
    keys = lexicon["feature"].to_numpy().view(U)
    by = np.argsort(keys)
    model = Model(keys[by], lexicon["e"].to_numpy()[by])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _parts(batches, 1):
            classes = shared.value.classes(found).astype(np.uint8)
            rows = [classes[a:b].tobytes() for a, b in zip(found.first, found.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(rows, pa.binary())], names=["toxic", "classes"])

    rest = sample.filter(third).orderBy(F.xxhash64(F.lit("field"), F.col(id_col))).select("toxic", "text")
    rows = rest.mapInArrow(classify, "toxic int, classes binary").toArrow()
    label = rows["toxic"].to_numpy()
    texts = [np.frombuffer(r, np.uint8).astype(np.int64) for r in rows["classes"].to_pylist()]
    least = np.searchsorted(EDGES, TOXIC) + 1
    taught = [i for kind in (1, 0) for i in np.flatnonzero(label == kind)[:FIELD_DOCUMENTS]]
    tags = [((texts[i] >= least) & (label[i] == 1)).astype(np.int64) for i in taught]
    if taught and any(len(texts[i]) for i in taught):
        fit_field(model, np.concatenate([texts[i] for i in taught]), _first([texts[i] for i in taught]), np.concatenate(tags))
    if len(set(label.tolist())) == 2:
        first, classes = _first(texts), np.concatenate(texts)
        p, _, _ = marginals(model.odds(classes, first), first, model.transition)
        model.curve = fit_curve(summary(p, first), label.astype(float))
    return model


def _first(texts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def score_documents(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxic_score", spans_col: str = "toxic_spans"
) -> DataFrame:
    """``docs`` with a score and spans (begin and end in bytes, and the span's strongest marginal).

    All columns are kept; name the new ones so that they are not among them.
    """
    if {score_col, spans_col} & set(docs.columns):
        raise ValueError(f"{score_col} or {spans_col} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def tag(texts: pa.Array) -> tuple[np.ndarray, list]:
        found, own = words(texts), shared.value
        p, _, _ = marginals(own.odds(own.classes(found), found.first), found.first, own.transition)
        n = np.diff(found.first)
        doc = np.repeat(np.arange(len(n)), n)
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        lengths = np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1])
        text_at = np.cumsum(lengths) - lengths
        hot = np.flatnonzero(p >= 0.5)
        spans: list[list] = [[] for _ in n]
        for i in hot.tolist():
            d = doc[i]
            begin, end = int(found.starts[i] - text_at[d]), int(found.ends[i] - text_at[d])
            if spans[d] and i - 1 == spans[d][-1]["last"]:
                spans[d][-1] |= {"last": i, "end": end, "probability": max(spans[d][-1]["probability"], float(p[i]))}
            else:
                spans[d].append({"last": i, "begin": begin, "end": end, "probability": float(p[i])})
        return own.score(p, found.first), [[{k: s[k] for k in ("begin", "end", "probability")} for s in row] for row in spans]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for begin, end in slices(batch.column(at), FINE):
                part = batch.slice(begin, end - begin)
                score, spans = tag(part.column(at))
                columns = [*part.columns, pa.array(score), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, score_col, spans_col])

    names = docs.columns
    spans = "array<struct<begin: bigint, end: bigint, probability: double>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score_col}` double", f"`{spans_col}` {spans}"])
    return docs.mapInArrow(run, schema)

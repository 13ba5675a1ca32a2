"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in hashed features of its words (the word and its
leading 4, 5 and 6 bytes); a document's is the noisy-or of its sentences'. Training sees
document labels alone, and the sentences that carry a label come out of the gradient of
the noisy-or. Scoring is one narrow pass over whole texts.

Defined results: a null or empty text has no sentence and scores 0; without labelled
rows, or with one label only, every score is that label's share (0 without any); a
doc_id that is labelled several times counts with its highest label, and one with several
texts trains with the least of them; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Labelled documents to train on at most, those with the smallest hashes of their ids; of any length.
TRAINING_DOCUMENTS = 8000
SPACE = 1 << 18
PREFIXES = (4, 5, 6)
ROUNDS = 120
#: Features that training adds up at a time.
STEP = 500_000
#: What every weight costs, in log-likelihood a document.
SHRINK = 2e-5
#: The folds by crc32 of the id; this one is held out.
FOLDS, HELD_OUT = 5, 0

_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in ".!?\n"]] = 1


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and the sentence of each; each sentence's text, first byte and last byte."""
    starts, ends, owner = common.find_words(data, offsets, common.ALNUM)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    breaks = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts]
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (breaks[1:] != breaks[:-1])])
    sentence = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    sums = common.prefix_sums(data)
    parts, owners = [common.span_hash(sums, starts, ends)], [sentence]
    for n in PREFIXES:
        long_ = ends - starts > n
        with np.errstate(over="ignore"):
            parts.append(common.mix(common.span_hash(sums, starts[long_], starts[long_] + n) + np.uint64(n)))
        owners.append(sentence[long_])
    features = (np.concatenate(parts) & np.uint64(SPACE - 1)).astype(np.int64)
    return features, np.concatenate(owners), owner[first], starts[first], ends[last]


def once(features: np.ndarray, sentence: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The useful features, one of a kind in a sentence: repeating a word says no more."""
    keep = useful[features]
    both = np.unique(sentence[keep] * np.int64(SPACE) + features[keep])
    return both % SPACE, both // SPACE


class Model:
    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None) -> None:
        self.weights, self.bias, self.constant = weights, bias, constant

    def sentences(self, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        features, sentence = once(features, sentence, self.weights > 0)
        z = np.bincount(sentence, self.weights[features], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        features, sentence, text, _, _ = featurize(data, offsets)
        p = self.sentences(features, sentence, len(text))
        return np.abs(np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n)))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents, and how many with the label, hold each feature."""
    holds, positive = np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64)
    for batch in common.chunks(batches):
        features, sentence, text, _, _ = featurize(*common.text_bytes(batch.column("text")))
        labels = batch.column("label").to_numpy().astype(np.int64)
        held = np.unique(features * np.int64(batch.num_rows) + text[sentence]) if len(features) else np.empty(0, np.int64)
        holds += np.bincount(held // batch.num_rows, minlength=SPACE)
        positive += np.bincount(held // batch.num_rows, labels[held % batch.num_rows], SPACE).astype(np.int64)
    at = np.flatnonzero(holds)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(holds[at]), pa.array(positive[at])], names=["feature", "holds", "positive"])


def _bags(batches: Iterator[pa.RecordBatch], useful) -> Iterator[pa.RecordBatch]:
    """Of each document: how many sentences hold no useful feature, and the features of those that do, with their sizes."""
    bits = np.zeros(SPACE, bool)
    bits[useful.value] = True
    for batch in common.chunks(batches):
        features, sentence, text, _, _ = featurize(*common.text_bytes(batch.column("text")))
        total = np.bincount(text, minlength=batch.num_rows)
        features, sentence = once(features, sentence, bits) if len(features) else (features, sentence)
        sizes = np.bincount(sentence, minlength=len(text)).astype(np.int32)
        some = np.flatnonzero(sizes)
        first = np.searchsorted(text[some], np.arange(batch.num_rows + 1))
        ends = np.concatenate([[0], np.cumsum(sizes[some])])
        raw, of = features.astype(np.int32), sizes[some]
        rows = [(raw[ends[i] : ends[j]].tobytes(), of[i:j].tobytes()) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        plain = total - np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(plain.astype(np.int64)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            names=["id", "label", "plain", "features", "sizes"],
        )


def fit(features: np.ndarray, sentence: np.ndarray, text: np.ndarray, plain: np.ndarray, labels: np.ndarray) -> Model:
    """Adam on the noisy-or's log-likelihood: features and their sentences in order, the sentences' documents, and each document's sentences without features.

    Weights are not negative: a sentence offends by what it holds, and ordinary words around that don't excuse it.
    Sums go over STEP features at a time, so that little memory is needed beside the features.
    """
    there = np.zeros(SPACE, bool)
    there[features] = True
    used = np.flatnonzero(there)
    column_of = (np.cumsum(there) - 1).astype(np.int32)
    steps = [slice(k, k + STEP) for k in range(0, len(features), STEP)]
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(0.01)
    m, v = np.zeros_like(w), np.zeros_like(w)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, ROUNDS + 1):
        z = np.full(len(text), w[-1])
        for s in steps:
            own = sentence[s]
            z[own[0] : own[-1] + 1] += np.bincount(own - own[0], w[column_of[features[s]]])
        p, p0 = squash(z), squash(w[-1])
        none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)) + plain * np.log1p(-p0)
        some = np.maximum(-np.expm1(none), 1e-9)
        of_document = np.where(labels > 0, -np.exp(none) / some, 1.0) / len(labels)
        push = of_document[text] * p
        grad = np.full(len(w), SHRINK)
        grad[-1] = push.sum() + (of_document * plain).sum() * p0
        for s in steps:
            grad[:-1] += np.bincount(column_of[features[s]], push[sentence[s]], len(used))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    weights = np.zeros(SPACE)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def fold(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS, F.lit(HELD_OUT + 1))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """A model from at most TRAINING_DOCUMENTS labelled documents outside the held-out fold.

    Only features that are likelier in labelled documents than in all can gain a weight, so no others are
    gathered. Texts stay with the workers: the driver gets these features by sentence.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id")) != HELD_OUT))
    # a bounded number of ids is chosen first, so that no text is shuffled to find them
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(TRAINING_DOCUMENTS)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = common.settle(texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    counts = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, n_positive = sum(counts.values()), counts.get(1, 0)
    if not n or not 0 < n_positive < n:
        return Model(np.zeros(SPACE), 0.0, n_positive / n if n else 0.0)
    bits = chosen.select("text", "label").mapInArrow(_bits, "feature bigint, holds bigint, positive bigint")
    bits = bits.groupBy("feature").agg(F.sum("holds").alias("holds"), F.sum("positive").alias("positive"))
    useful = bits.where((F.col("holds") >= 3) & (F.col("positive") * n > F.col("holds") * n_positive)).select("feature").toArrow()
    shared = spark.sparkContext.broadcast(useful["feature"].to_numpy())
    kind = chosen.schema["id"].dataType.simpleString()
    bags = chosen.mapInArrow(lambda it: _bags(it, shared), f"id {kind}, label int, plain bigint, features binary, sizes binary").toArrow().sort_by("id")
    features, sizes = (np.frombuffer(b"".join(x.as_buffer() for x in bags[c]), np.int32) for c in ("features", "sizes"))
    of_text = np.array([len(x.as_buffer()) // 4 for x in bags["sizes"]])
    plain, label = (bags[c].to_numpy().astype(np.float64) for c in ("plain", "label"))
    del bags
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    model = fit(features, sentence, np.repeat(np.arange(len(label), dtype=np.int32), of_text), plain, label)
    del features, sizes, sentence
    common.release(spark)
    return model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        score = model.value.documents(*common.text_bytes(batch.column("text")))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id_col and the document's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", made.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return made.mapInArrow(lambda it: _score(it, shared), schema).withColumnRenamed("id", id_col)


def _locate(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        data, offsets = common.text_bytes(batch.column("text"))
        features, sentence, text, start, end = featurize(data, offsets)
        p = model.value.sentences(features, sentence, len(text)) if len(text) else np.empty(0)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        hit = np.flatnonzero(p >= least)
        base = points[offsets[:-1]][text[hit]] if len(hit) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(text[hit])), pa.array(points[start[hit]] - base), pa.array(points[end[hit]] - base), pa.array(p[hit])], names=["id", "start", "end", "score"]
        )


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The sentences scored least or more: id_col, start and end (code points, from first to last word), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", made.schema["id"].dataType), *(T.StructField(c, k) for c, k in (("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType())))])
    return made.mapInArrow(lambda it: _locate(it, shared, least), schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below least, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return score(whole, model, "row").where(F.col("score") < least).select("row.*")

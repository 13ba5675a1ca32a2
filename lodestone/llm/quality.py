"""Quality by weak labels: overlapping heuristics vote, EM weighs them, a hashed linear scorer learns from the posterior.

Every heuristic votes clean, junk or nothing for every document. The votes of all documents
are counted by pattern (at most 3^n of them), and expectation-maximisation over these
counts estimates the share of clean documents and how each heuristic votes on them and on
junk of several kinds, without any labels. The posterior of its pattern is a document's weak label. A logistic
scorer on hashed shapes of words then learns the weak labels of a bounded sample, and
scores all documents.

Defined results: a null or empty text gets the vote of length alone; an empty table gives
no rows; repeated rows are scored each; a corpus whose votes are all alike scores all
documents at their posterior; a pattern of votes that training has not seen is scored by
the fitted tables; rows with a null doc_id are counted and scored, but not sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

HEURISTICS = ("capitals", "symbols", "bars", "shouting", "repeated_lines", "repeated_runs", "length", "punctuation", "word_size")
JUNK, NONE, CLEAN = 0, 1, 2
#: Share of clean documents that a heuristic votes against at most.
FALSE_ALARMS = 0.03
#: Documents with the smallest hashes of id that the scorer is fitted on, at most; of any length.
TRAINING_DOCUMENTS = 6000
SPACE = 1 << 16
ROUNDS = 80

_LINES = np.ones(256, bool)
_LINES[10] = False


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each text: counts of bytes of some kinds, of words, of repeated lines and of repeated runs of three words."""
    n = len(offsets) - 1

    def count(bytes_: str) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[[ord(c) for c in bytes_]] = 1
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])

    starts, ends, owner = common.find_words(data, offsets, common.SPACED)
    sums = common.prefix_sums(data)
    hashes = common.span_hash(sums, starts, ends)
    words = np.bincount(owner, minlength=n)
    last = np.zeros(256, np.int64)
    last[[ord(c) for c in ".,;:?"]] = 1
    closed = np.bincount(owner, last[data[ends - 1]] if len(ends) else None, n)
    ls, le, lo = common.find_words(data, offsets, _LINES)
    line = common.span_hash(sums, ls, le)

    def repeats(key: np.ndarray, who: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weight of all that has come before in its text."""
        with np.errstate(over="ignore"):
            _, first = np.unique(common.mix(key + common.mix(who.astype(np.uint64))), return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        return np.bincount(who[again], weight[again], n)

    run = np.empty(0, np.uint64)
    who = np.empty(0, np.int64)
    if len(hashes) > 2:
        with np.errstate(over="ignore"):
            run = common.mix(common.mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
        same = owner[:-2] == owner[2:]
        run, who = run[same], owner[:-2][same]
    upper = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return {
        "upper": upper,
        "letters": upper + count("abcdefghijklmnopqrstuvwxyz"),
        "symbols": count("*#$%&@^~=<>{}[]\\_+"),
        "bars": count("|"),
        "shouts": count("!"),
        "words": words,
        "bytes": np.diff(offsets) - count(" \n\t\r"),
        "closed": closed,
        "lines": np.bincount(lo, minlength=n),
        "line_bytes": np.bincount(lo, le - ls, n),
        "repeated_lines": repeats(line, lo, (le - ls).astype(float)),
        "runs": np.bincount(who, minlength=n),
        "repeated_runs": repeats(run, who, np.ones(len(run))),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """[document, heuristic]: JUNK, NONE or CLEAN."""
    words, some = m["words"], np.maximum(m["words"], 1)

    def between(value: np.ndarray, clean: float, junk: float, known: np.ndarray) -> np.ndarray:
        """Clean up to one bound, junk from the other on."""
        return np.where(~known, NONE, np.where(value <= clean, CLEAN, np.where(value >= junk, JUNK, NONE)))

    size = m["bytes"] / some
    closed = m["closed"] / some
    columns = [
        between(m["upper"] / np.maximum(m["letters"], 1), 0.15, 0.4, m["letters"] >= 10),
        between(m["symbols"] / some, 0.05, 0.3, words >= 1),
        between(m["bars"] / some, 0.02, 0.2, words >= 5),
        between(m["shouts"] / some, 0.05, 0.3, words >= 5),
        between(m["repeated_lines"] / np.maximum(m["line_bytes"], 1), 0.05, 0.3, m["lines"] >= 2),
        between(m["repeated_runs"] / np.maximum(m["runs"], 1), 0.1, 0.3, m["runs"] >= 10),
        np.where(words < 1, JUNK, np.where(words >= 20, CLEAN, NONE)),
        np.where(words < 10, NONE, np.where((closed >= 0.02) & (closed <= 0.4), CLEAN, JUNK)),
        np.where(words < 3, NONE, np.where((size >= 3) & (size <= 10), CLEAN, np.where((size < 2) | (size > 16), JUNK, NONE))),
    ]
    return np.stack(columns, axis=1).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


class Labeller:
    """The posterior of every pattern of votes.

    Junk is of several kinds that hardly overlap, so besides the clean documents there is a
    kind of junk for each heuristic, at first those that it votes against. Within a kind
    votes are independent; EM finds the kinds' shares and each heuristic's votes on each.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 300) -> None:
        codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in codes.tolist()], np.float64)
        hot = self._evidence(codes)
        kinds = len(HEURISTICS) + 1
        prior = np.broadcast_to([0.2, 1e-9, 2.0], (kinds, len(HEURISTICS), 3)).copy()
        prior[1 + np.arange(len(HEURISTICS)), np.arange(len(HEURISTICS))] = [4.0, 1e-9, 0.2]
        post = np.concatenate([np.full((len(n), 1), 0.1), hot[:, :, JUNK]], axis=1)  # [pattern, kind]
        post /= post.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            weighed = post * n[:, None]
            share = (weighed.sum(axis=0) + 1) / (n.sum() + kinds)
            told = np.einsum("pk,phv->khv", weighed, hot) + prior
            told /= told.sum(axis=2, keepdims=True)
            told[0, :, JUNK] = np.minimum(told[0, :, JUNK], FALSE_ALARMS)
            self.share, self.told = share, told
            new = self._posterior(hot)
            if not len(n) or np.abs(new - post).max() < 1e-9:
                break
            post = new
        junk = np.einsum("k,khv->hv", share[1:] / share[1:].sum(), told[1:])
        self.accuracy = {h: (float(told[0, k, CLEAN] / (told[0, k, CLEAN] + told[0, k, JUNK])), float(junk[k, JUNK] / (junk[k, CLEAN] + junk[k, JUNK]))) for k, h in enumerate(HEURISTICS)}

    @staticmethod
    def _evidence(codes: np.ndarray) -> np.ndarray:
        """[pattern, heuristic, vote]; a heuristic that says nothing is no evidence."""
        hot = np.eye(3)[codes[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3]
        hot[:, :, NONE] = 0
        return hot

    def _posterior(self, hot: np.ndarray) -> np.ndarray:
        like = np.einsum("phv,khv->pk", hot, np.log(self.told)) + np.log(self.share)
        new = np.exp(like - like.max(axis=1, keepdims=True)) if len(like) else like
        return new / new.sum(axis=1, keepdims=True)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        """The probability of a clean document, also for patterns that no document showed before."""
        codes, which = np.unique(pattern(v), return_inverse=True)
        return self._posterior(self._evidence(codes))[:, 0][which.ravel()]


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("x")
_SHAPE[65:91] = ord("X")
_SHAPE[48:58] = ord("9")


def featurize(data: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their texts and weights: shares of the words' shapes, and of repeats by tenths."""
    n = len(offsets) - 1
    shape = _SHAPE[data]
    starts, ends, owner = common.find_words(data, offsets, common.SPACED)
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    kept = np.flatnonzero(new)
    squeezed = shape[kept]
    # X and x differ here, so upper case is moved out of the way of lower-casing
    sums = common.prefix_sums(np.where(squeezed == ord("X"), np.uint8(1), squeezed))
    word = common.span_hash(sums, np.searchsorted(kept, starts), np.searchsorted(kept, ends))
    features = [(word & np.uint64(SPACE - 1)).astype(np.int64)]
    owners, weights = [owner], [1 / np.maximum(np.bincount(owner, minlength=n), 1)[owner]]
    for k, (part, whole) in enumerate((("repeated_lines", "line_bytes"), ("repeated_runs", "runs"))):
        tenth = np.minimum(10 * m[part] / np.maximum(m[whole], 1), 9).astype(np.int64)
        features.append(((tenth + 10 * k + 1) * 2654435761) % SPACE)
        owners.append(np.arange(n))
        weights.append(np.ones(n))
    return np.concatenate(features), np.concatenate(owners), np.concatenate(weights)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, features: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, self.weights[features] * weight, n) + self.bias, -30, 30)))


def fit(features: np.ndarray, owner: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> Scorer:
    """Adam on the cross-entropy with probabilistic labels."""
    used, column = np.unique(features.astype(np.int64), return_inverse=True)
    owner = owner.astype(np.int64)
    w = np.zeros(len(used) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column] * weight, len(labels)) + w[-1], -30, 30)))
        push = (p - labels) / max(len(labels), 1)
        grad = np.append(np.bincount(column, push[owner] * weight, len(used)), push.sum()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(SPACE)
    weights[used] = w[:-1]
    return Scorer(weights, float(w[-1]))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        codes, n = np.unique(pattern(votes(measures(*common.text_bytes(batch.column("text"))))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    labeller, scorer = model.value
    for batch in common.chunks(batches):
        data, offsets = common.text_bytes(batch.column("text"))
        m = measures(data, offsets)
        v = votes(m)
        weak = labeller(v)
        score = scorer(*featurize(data, offsets, m), batch.num_rows)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array((v != NONE).sum(axis=1).astype(np.int64)), pa.array(weak), pa.array(score)], names=[*names, "n_votes", "weak_label", "score"]
        )


def _samples(batches: Iterator[pa.RecordBatch], labeller) -> Iterator[pa.RecordBatch]:
    """Of each document its distinct features with their weights, and its weak label."""
    for batch in common.chunks(batches):
        data, offsets = common.text_bytes(batch.column("text"))
        m = measures(data, offsets)
        features, owner, weight = featurize(data, offsets, m)
        both, which = np.unique(owner * np.int64(SPACE) + features, return_inverse=True)
        total = np.bincount(which.ravel(), weight, len(both)).astype(np.float32)
        cuts = np.searchsorted(both, np.arange(batch.num_rows + 1) * np.int64(SPACE))
        feature = (both % SPACE).astype(np.int32)
        packed = [[x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())] for x in (feature, total)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.binary()) for x in packed), pa.array(labeller.value(votes(m)))], names=["id", "features", "weights", "label"])


def train(docs: DataFrame) -> tuple[Labeller, Scorer]:
    """EM over the votes of all documents, then the scorer on a bounded sample of documents of any length; texts stay with the workers."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_patterns, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    labeller = Labeller({r.code: r.n for r in counted.collect()})
    # ids are chosen first, so that no text is sorted to find the sample; of a repeated id the least text counts
    chosen = texts.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAINING_DOCUMENTS)
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(labeller)
    schema = T.StructType([sample.schema["id"], T.StructField("features", T.BinaryType()), T.StructField("weights", T.BinaryType()), T.StructField("label", T.DoubleType())])
    bags = sample.mapInArrow(lambda it: _samples(it, shared), schema).toArrow().sort_by("id")
    features = np.frombuffer(b"".join(bags["features"].to_pylist()), np.int32)
    owner = np.repeat(np.arange(len(bags)), [len(x) // 4 for x in bags["features"].to_pylist()])
    return labeller, fit(features, owner, np.frombuffer(b"".join(bags["weights"].to_pylist()), np.float32), bags["label"].to_numpy())


def score(docs: DataFrame, model: tuple[Labeller, Scorer], id_col: str = "doc_id") -> DataFrame:
    """id_col, n_votes, weak_label and score, both the probability of a clean text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([made.schema["id"], T.StructField("n_votes", T.LongType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return made.mapInArrow(lambda it: _score(it, shared), schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_votes, weak_label, score, kept."""
    return score(docs, train(docs)).withColumn("kept", F.col("score") >= 0.5)

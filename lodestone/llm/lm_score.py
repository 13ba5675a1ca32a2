"""Cross-entropy difference: a target and a background bigram model over one vocabulary.

Words are 56-bit hashes (A-Z lower-cased) with a bit that tells words from bigrams. Every
word and bigram of either side counts, so the models grow with the texts; they are never
with one process. Their keys are dealt to parts whose number grows with the texts:

1. Texts are put into blocks, which learn by id which of their texts are of the target. A block sends its distinct words and bigrams to their parts,
   with what it adds to their counts, as packed sorted keys.
2. A part adds up the counts of all blocks and answers each block with the sums. A block
   sends a key once, so a key that is in every text weighs no more than any other.
3. The answers meet their block, and losses under both models are added up word by word.
   Bigrams fall back to the unigram by the Dirichlet prior, as do words in neither side.

The target is any set of documents; the query takes those labelled as of good quality.
A text's own counts are left out of the models that score it, so that none is like itself.
The score is the mean over words of the background's loss less the target's, in bits:
higher is more like the target.

Defined results: a null or empty text has no words, losses of null and a score of 0; an
empty target or background has uniform models; repeated rows count and are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Weight of the unigram model in a bigram's probability, in counts.
PRIOR = 50.0
#: Entries that a block holds before it adds them up.
HELD = 400_000
#: Bytes of text for each part of the models, and in a block.
PART_BYTES, BLOCK_BYTES = 8_000_000, 8_000_000
#: Bits of a key.
KEY = np.uint64((1 << 56) - 1)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words (even) and their texts; keys of the bigrams within texts (odd) and the places of their second words."""
    data, offsets = common.text_bytes(batch.column("text"))
    starts, ends, owner = common.find_words(data, offsets, common.ALNUM)
    words = common.word_hashes(data, starts, ends) & KEY & ~np.uint64(1)
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    with np.errstate(over="ignore"):
        pairs = common.mix(common.mix(words[at - 1]) + words[at]) & KEY | np.uint64(1)
    return words, owner, pairs, at


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each key is in its own text."""
    with np.errstate(over="ignore"):
        both = common.mix(keys + common.mix(owner.astype(np.uint64)))
    _, which, times = np.unique(both, return_inverse=True, return_counts=True)
    return times[which.ravel()]


def _split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The run of sorted keys of each part: parts are equal ranges of the keys' high bits."""
    part = ((keys >> np.uint64(25)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(part[a]), slice(a, b)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, like bytes together and compressed, so that the workers' JVM holds them compressed too."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _rows(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c in ("keys", "m", "n", "body") else pa.int64()) for c, v in columns.items()})


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, and their counts in target and background."""
    keys, m, n = (np.concatenate(x) for x in zip(*parts))
    known, which = np.unique(keys, return_inverse=True)
    return known, *(np.bincount(which, x, len(known)).astype(np.int64) for x in (m, n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their ids, about BLOCK_BYTES in a row."""
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = made = 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        return _rows(block=[first + made], body=[sink.getvalue().to_pybytes()])

    for batch in common.chunks(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield block()
            held, size, made = [], 0, made + 1
    if held:
        yield block()


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
            at = 0
            for held in pa.ipc.open_stream(body):
                n = held.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), pa.array(np.arange(at, at + n)), held.column(0)], names=["block", "place", "id"])
                at += n


def _texts(body: bytes, places: list[int] | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A block's texts, and which of them are of the target (also those at places) and of the background."""
    at = 0
    told = np.array(places or [], np.int64)
    for batch in common.chunks(iter(pa.ipc.open_stream(body))):
        one, two = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("one", "two"))
        here = told[(told >= at) & (told < at + batch.num_rows)] - at
        one[here] = 1
        yield batch, one, two
        at += batch.num_rows


def _counted(body: bytes, places: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys of a block, and their counts in its texts of either side."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch, *flags in _texts(body, places):
        words, owner, pairs, at = _words(batch)
        sides = [np.concatenate([own, own[at]]) for own in (flag[owner] for flag in flags)]
        held.append(_added([(np.concatenate([words, pairs]), *sides)]))
        if sum(len(x[0]) for x in held) > HELD:
            held = [_added(held)]
    return _added(held)


def _keys(body: bytes) -> np.ndarray:
    held = [np.unique(np.concatenate([words, pairs])) for words, _, pairs, _ in (_words(batch) for batch, _, _ in _texts(body, None))]
    return np.unique(np.concatenate(held))


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The keys of each block by part, with what the block adds to their counts."""
    for batch in batches:
        for block, body, places in zip(*(batch.column(c).to_pylist() for c in ("block", "body", "places"))):
            keys, m, n = _counted(body, places)
            rows = [(block, p, _pack_keys(keys[at]), _pack(m[at]), _pack(n[at])) for p, at in _split(keys, parts)]
            yield _rows(**{c: [r[k] for r in rows] for k, c in enumerate(("block", "part", "keys", "m", "n"))})


def _merge(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """One part of both models, and the places of each block's keys in it."""
    keys = [_unpack_keys(k) for k in asked.column("keys").to_pylist()]
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    m, n = (np.bincount(which, np.concatenate([_unpack(x, np.int64) for x in asked.column(c).to_pylist()]), len(known)).astype(np.int64) for c in ("m", "n"))
    return known, m, n, np.split(which, np.cumsum([len(k) for k in keys])[:-1])


_ANSWERS = "block bigint, part bigint, m binary, n binary, size bigint, words_m bigint, words_n bigint"


def _answer(asked: pa.Table) -> pa.Table:
    """Counts in both sides of each block's keys, in their order; and a row without block that holds the part's sums."""
    keys, m, n, places = _merge(asked)
    word = keys & np.uint64(1) == 0
    sums = [int(x) for x in ((word & (m + n > 0)).sum(), m[word].sum(), n[word].sum())]
    rows = [(None, None, None, None, *sums)]
    for block, part, at in zip(asked.column("block").to_pylist(), asked.column("part").to_pylist(), places):
        rows.append((block, part, _pack(m[at]), _pack(n[at]), None, None, None))
    names = [f.split()[0] for f in _ANSWERS.split(", ")]
    return pa.Table.from_batches([_rows(**{c: [r[k] for r in rows] for k, c in enumerate(names)})])


def _score(texts: pa.Table, answers: pa.Table, parts: int, sums: tuple[int, int, int], schema: pa.Schema) -> pa.Table:
    size, *totals = sums
    out = []
    told = {p: (m, n) for p, m, n in zip(*(answers.column(c).to_pylist() for c in ("part", "m", "n")))}
    for body, places in zip(texts.column("body").to_pylist(), texts.column("places").to_pylist()):
        keys = _keys(body)
        sides = np.zeros((2, len(keys)))
        for p, at in _split(keys, parts):
            for side, packed in zip(sides, told[p]):
                side[at] = _unpack(packed, np.int64)
        for batch, *flags in _texts(body, places):
            words, owner, pairs, at = _words(batch)
            place, of_pair = np.searchsorted(keys, words), np.searchsorted(keys, pairs)
            n = np.bincount(owner, minlength=batch.num_rows)
            own_word, own_pair = _own(words, owner), _own(pairs, owner[at])
            losses = []
            for side, total, flag in zip(sides, totals, flags):
                counts = flag[owner]  # whether the text is of this side, and its own counts to be left out
                word, pair = side[place] - own_word * counts, side[of_pair] - own_pair * counts[at]
                p = (word + 1) / (total - n[owner] * counts + size + 1)
                p[at] = (pair + PRIOR * p[at]) / (word[at - 1] + PRIOR)
                losses.append(np.bincount(owner, -np.log2(p), batch.num_rows) / np.maximum(n, 1))
            empty, (one, two) = n == 0, losses
            values = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(one, mask=empty), pa.array(two, mask=empty), pa.array(np.where(empty, 0.0, two - one))]
            out.append(pa.table(values, schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def text_size(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0


def score(texts: DataFrame, size: int, target: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, target_loss and background_loss in bits a word, score.

    Columns one and two, booleans, tell which texts are of the target and of the background; the ids in target's
    only column are of the target as well. size is the bytes of all texts.
    """
    spark = texts.sparkSession
    parts = size // PART_BYTES + 1
    made = texts.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"), "one", "two")
    # settled, as a block has to be the same texts when it asks and when it is answered
    blocks = common.settle(made.mapInArrow(_blocks, "block bigint, body binary"), "blocks")
    if target is None:
        blocks = blocks.withColumn("places", F.lit(None).cast("array<bigint>"))
    else:
        # ids are joined and not texts; blocks are few, and labels grow with the documents, so the join is planned alike at every size
        ids = blocks.mapInArrow(_ids, T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), made.schema["id"]]))
        known = target.toDF("id").where("id is not null").distinct()
        told = ids.hint("merge").join(known.hint("merge"), "id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("places"))
        plain, told = blocks, common.settle(told, "targets")
        blocks = common.settle(plain.hint("merge").join(told.hint("merge"), "block", "left"), "blocks")
        common.forget(plain, told)
    common.release(spark)
    asked = blocks.mapInArrow(lambda it: _ask(it, parts), "block bigint, part bigint, keys binary, m binary, n binary")
    answers = common.settle(asked.groupBy("part").applyInArrow(_answer, _ANSWERS), "answers")
    common.release(spark)
    sums = tuple(answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "words_m", "words_n"))).first())
    fields = [made.schema["id"], T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))]
    schema = made.select("id").limit(0).toArrow().schema
    for f in fields[1:]:
        schema = schema.append(pa.field(f.name, pa.int64() if f.name == "n_words" else pa.float64()))
    told = answers.where("block is not null").select("block", "part", "m", "n")
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, parts, sums, schema), T.StructType(fields))
    return scored.withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document, against the documents labelled as of good quality."""
    texts = docs.select("doc_id", "text", F.lit(False).alias("one"), F.lit(True).alias("two"))
    return score(texts, text_size(docs), labels.where("quality = 1").select("doc_id"))

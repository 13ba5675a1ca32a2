"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct 3-word shingles as 64-bit hashes. Documents with
equal sets (by size and a 128-bit digest of the whole set) are one class, whose smallest
document stands for it. SuperMinHash gives each
element one rank per level, at the places of a random permutation of the element, so
that places are correlated and the signature varies less than with independent hashes;
it stops at the level at which all places are filled.

Classes meet where a band of ROWS places is equal. A bucket is not paired off. Its
smallest class leads: every other is compared with it on full sets. The Jaccard distance
d is a metric, so for a link bound of 0.15 members linked to the leader are settled with
each other through it, and a member f at distance d(f) over 0.30 cannot be linked to any
of them. What is left in a bucket - those not linked, and, for members between 0.15 and
0.30, the linked ones with d >= d(f) - 0.15 - is put in blocks by component: members of the
largest component need comparing with the others only. Two blocks at a time are compared
on full sets. So no pair that shares a bucket is left undecided, a large group of copies
costs one comparison a member, and no task holds more than two blocks.

Two sets at the threshold share no band with probability under MISSED. Keys that hold very
many rows (large groups of copies) are split: their rows stay where they are and meet the
few hot keys, or are dealt to parts of a key that each hold PART rows.

Defined results: a null or empty text has an empty set, no links, and is its own
component; fewer than three words make one shingle; repeated doc_ids are one document
for links (rows stay), linked through any of its texts; rows with a null doc_id are kept
and linked with nothing. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common
from lodestone.llm.components import components

#: Words of a shingle of the contract query, and of pipelines.
QUERY_WORDS, PIPELINE_WORDS = 3, 5
#: Per cent of the union that a link needs, for the same.
QUERY_PERCENT, PIPELINE_PERCENT = 85, 80
#: Bands where they suffice, and how likely a pair at the threshold may share none.
BANDS, MISSED = 32, 1e-7
#: Pairs of one leader that are compared in one task.
PART = 1000
#: Members of a block and shingles that they have together, about, and columns of the table that two blocks are compared on at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 128, 100_000, 4096
#: Elements whose permutations are held at a time: 16 MB.
ELEMENTS = 100_000


def banding(percent: int) -> tuple[int, int]:
    """Bands, and places of each: as many places as keep missed pairs rare; more bands where one place is too many."""
    like = percent / 100
    for rows in range(7, 0, -1):
        if (1 - like**rows) ** BANDS < MISSED:
            return BANDS, rows
    bands = math.ceil(math.log(MISSED) / math.log(1 - like))
    if bands > 255:
        raise ValueError(f"a similarity of {percent} per cent is too low for signatures")
    return bands, 1


def shingles(hashes: np.ndarray, owner: np.ndarray, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of words (of all words, where a text has fewer), and where each text's begin."""
    first = np.searchsorted(owner, np.arange(rows + 1))
    counts = np.diff(first)
    kept = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    cuts = np.concatenate([[0], np.cumsum(kept)])
    at = np.arange(cuts[-1]) + np.repeat(first[:-1] - cuts[:-1], kept)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    who = np.concatenate([owner, np.full(words, -1)])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            word = np.where(who[at + k] == who[at], padded[at + k], np.uint64(0)) if len(at) else out
            out = common.mix(out * np.uint64(0x2545F4914F6CDD1D) + word)
    return out, cuts


def super_minhash(elements: np.ndarray, cuts: np.ndarray, places: int) -> np.ndarray:
    """Signatures of the sets elements[cuts[i]:cuts[i+1]] (repeats do no harm); a place holds level and rank."""
    sets = len(cuts) - 1
    out = np.full(sets * places, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(cuts))
    active, state = owner, elements
    perm = None
    for level in range(places):
        with np.errstate(over="ignore"):
            draw = common.mix(state + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
            swap = level + ((draw >> np.uint64(32)) * np.uint64(places - level) >> np.uint64(32)).astype(np.int64)
            rank = (common.mix(draw) >> np.uint64(8)) | np.uint64(level << 56)
        if perm is None:
            place = swap
        else:
            line = np.arange(len(active)) * places
            place = perm[line + swap].astype(np.int64)
            perm[line + swap] = perm[line + level]
        np.minimum.at(out, active * places + place, rank)
        open_ = (out.reshape(sets, places) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_[active]
        if not keep.any():
            break
        if perm is None:
            active, state, swap = active[keep], state[keep], swap[keep]
            perm = np.tile(np.arange(places, dtype=np.uint8), len(active))
            perm[np.arange(len(active)) * places + swap] = 0
        elif not keep.all():
            perm = perm.reshape(len(active), places)[keep].ravel()
            active, state = active[keep], state[keep]
    return out.reshape(sets, places)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = signatures.shape[1] // rows
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1), len(signatures), axis=0)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = common.mix(out * np.uint64(0x2545F4914F6CDD1D) + signatures[:, k::rows][:, :bands])
    return out.view(np.int64)


_MARKS = "id bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>"
_SETS = "id bigint, one bigint, n_shingles bigint, shingles array<bigint>"


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each, and where each text's begin."""
    data, offsets = common.text_bytes(batch.column("text"))
    starts, ends, owner = common.find_words(data, offsets, common.SPACED)
    hashes, cuts = shingles(common.word_hashes(data, starts, ends), owner, batch.num_rows, words)
    sets = [np.unique(hashes[cuts[k] : cuts[k + 1]]) for k in range(batch.num_rows)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _digests(flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """128 bits of each whole set, as two numbers."""
    raw = memoryview(np.ascontiguousarray(flat, "<u8").tobytes())
    return np.frombuffer(b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())), "<i8").reshape(-1, 2)


def _marks(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Of each text: its set's size, the digest that equal sets share, and its bands."""
    for batch in common.chunks(batches):
        flat, cuts = _sets(batch, words)
        sizes = np.diff(cuts)
        one, two = _digests(flat, cuts).T.copy()
        keys = np.empty((batch.num_rows, bands), np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + ELEMENTS, side="right")) - 1)
            keys[at:to] = band_keys(super_minhash(flat[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at], bands * rows), rows)
            at = to
        held = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(held), pa.array(keys[sizes > 0].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(one), pa.array(two), lists], names=["id", "n_shingles", "one", "two", "bands"])


def _members(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        flat, cuts = _sets(batch, words)
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_digests(flat, cuts)[:, 0]), pa.array(np.diff(cuts)), lists], names=["id", "one", "n_shingles", "shingles"])


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) classes -> a, b, ok, far, d, weight of a: whether they are linked, too far to share links, and their distance (a lower bound if sizes alone tell)."""
    pairs = common.settle(pairs, "pairs")
    total = pairs.count()
    # a leader of very many is dealt to parts of PART pairs, each with its set
    many = common.hot(common.settle(pairs.groupBy("b").agg(F.count("*").alias("n")), "leaders"), total).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).drop("n")
    dealt = pairs.join(many, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).drop("parts")
    one, two = (sets.select(F.struct("id", "one").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    two = two.join(many, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = dealt.join(one, "a").join(two, ["b", "part"])
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    shared = F.when(least * 100 >= most * percent, F.size(F.array_intersect("s_a", "s_b")).cast("bigint"))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    like = F.when(F.col("shared").isNull(), least / most).otherwise(F.col("shared") / union)
    return (
        both.withColumn("shared", shared)
        .withColumn("ok", F.coalesce(F.col("shared") * 100 >= union * percent, F.lit(False)))
        .withColumn("d", 1 - like)
        .select("a", "b", "ok", "d", F.col("n_a").alias("weight"), (F.col("d") > 2 * (1 - percent / 100) + 1e-9).alias("far"))
    )


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links among at most two blocks of members: one each for what would still join two components."""
    ids, roots, main = (table[c].to_numpy() for c in ("id", "root", "main"))
    lists = table["shingles"].combine_chunks()
    cuts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    sizes = np.diff(cuts)
    owner = np.repeat(np.arange(len(ids)), sizes)
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    # a shingle that one member has adds to no intersection
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column.ravel()]
    owner, number = owner[number >= 0], number[number >= 0]
    shared = np.zeros((len(ids), len(ids)), np.float32)
    for low in range(0, int((times > 1).sum()), COLUMNS):
        at = (number >= low) & (number < low + COLUMNS)
        held = np.zeros((len(ids), COLUMNS), np.float32)
        held[owner[at], number[at] - low] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    one, two = np.nonzero(np.triu(shared * 100 >= union * percent, 1) & (roots[:, None] != roots[None, :]) & ~(main[:, None] & main[None, :]))
    parent = {r: r for r in roots.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(one.tolist(), two.tolist()):
        x, y = root(int(roots[i])), root(int(roots[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})


def _links(entries: DataFrame, leads: DataFrame, total: int, sets: DataFrame, percent: int) -> DataFrame:
    """Links, as edges (u, v) of ids, that give the components of the classes (id, one) that meet in buckets: entries (key, c), leads (key, b, n), total entries."""
    reach = 1 - percent / 100
    met = common.settle(common.hot_join(entries, leads, ["key"], total).where("c <> b").select("key", F.col("c").alias("a"), "b"), "met")
    told = common.settle(_compare(met.select("a", "b").distinct(), sets, percent), "told")
    common.release(sets.sparkSession)
    edges = told.where("ok").select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    rows = common.settle(met.join(told, ["a", "b"]).select("key", F.col("a").alias("c"), "weight", "ok", "far", "d"), "decided")
    left = rows.groupBy("key").agg(F.count_if(~F.col("ok")).alias("n_open"), F.min(F.when(~F.col("ok") & ~F.col("far"), F.col("d"))).alias("border"), F.count("*").alias("n"))
    left = common.settle(left.where("n > 1 and (n_open > 1 or (border is not null and n > n_open))").select("key", "border", "n"), "left")
    rest = common.hot_join(rows, left, ["key"], total).where(~F.col("ok") | (F.col("d") >= F.col("border") - reach - 1e-9)).select("key", "c", F.col("c.id").alias("id"), "weight")
    rest = common.settle(rest, "rest")
    common.release(sets.sparkSession)
    if rest.isEmpty():
        return edges
    roots = components(edges)
    rest = common.settle(rest.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id")), "rest")
    sizes = common.settle(rest.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("mark")), "sizes")
    # of buckets with the same members one is enough, and one component needs no more links
    split = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root", "weight")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("mark").alias("mark")).where("roots > 1")
    once = split.groupBy("mark", "n").agg(F.min(F.struct("key", "main", "weight")).alias("x"))

    def blocks(n: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, weight / BLOCK_SHINGLES)).cast("int")

    main = F.col("x.main")
    once = once.select("x.key", "n", main["root"].alias("main_root"), blocks(main["n"], main["weight"]).alias("main_blocks"), blocks(F.col("n") - main["n"], F.col("x.weight") - main["weight"]).alias("open_blocks"))
    once = common.settle(once, "buckets")
    members = common.hot_join(rest, once, ["key"], total).withColumn("main", F.col("root") == F.col("main_root"))
    own = F.pmod(F.xxhash64("c"), F.when(F.col("main"), F.col("main_blocks")).otherwise(F.col("open_blocks"))).cast("int")
    # blocks of open members meet each other, and each of the largest component's; the first of either kind meet in one
    open_to = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda j: F.concat_ws("-", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    open_to = F.concat(open_to, F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: F.concat_ws("-", F.col("own"), F.concat(F.lit("m"), j))))
    main_to = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda j: F.concat_ws("-", j, F.concat(F.lit("m"), F.col("own"))))
    alone = (F.col("main_blocks") == 1) & (F.col("open_blocks") == 1)
    meets = F.when(alone, F.array(F.lit(""))).when(F.col("main"), main_to).otherwise(open_to)
    members = members.withColumn("own", own).select("key", "c", "id", "root", "main", F.explode(meets).alias("place"))
    members = members.join(sets.select(F.struct("id", "one").alias("c"), "shingles"), "c").drop("c")
    found = members.groupBy("key", "place").applyInArrow(lambda t: _block_links(t, percent), "u bigint, v bigint")
    return edges.union(common.settle(found, "links"))


def groups(docs: DataFrame, id_col: str = "doc_id", words: int = QUERY_WORDS, percent: int = QUERY_PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs; of a repeated id every row, with its own set's size."""
    bands, rows = banding(percent)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number")
    spark = docs.sparkSession
    made = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    marks = common.settle(made.mapInArrow(lambda it: _marks(it, words, bands, rows), _MARKS), "marks")
    some = marks.where("id is not null and n_shingles > 0")
    same = ["one", "two", "n_shingles"]
    total = some.count()
    classes = common.settle(some.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    first = some.groupBy("id", *same).agg(F.first("bands").alias("bands")).join(classes.select(*same, F.col("rep").alias("id")), [*same, "id"], "left_semi")
    entries = common.settle(first.select(F.struct("id", "one").alias("c"), F.explode("bands").alias("key")), "entries")
    leads = common.settle(entries.groupBy("key").agg(F.min("c").alias("b"), F.count("*").alias("n")).where("n > 1"), "leads")
    met = entries.count()
    common.release(spark)
    # whole sets only of those that meet another; planned alike at every size
    meeting = common.settle(common.hot_join(entries, leads, ["key"], met).select("c").distinct(), "meeting")
    texts = made.hint("merge").join(meeting.select(F.col("c.id").alias("meeting")).distinct().hint("merge"), F.col("id") == F.col("meeting"), "left_semi")
    sets = texts.mapInArrow(lambda it: _members(it, words), _SETS)
    sets = common.settle(sets.join(meeting.select("c.id", "c.one").hint("merge"), ["id", "one"], "left_semi").dropDuplicates(["id", "one"]), "sets")
    common.release(spark)
    links = _links(entries, leads, met, sets, percent)
    # a document joins the classes of all its texts
    again = common.hot_join(some.select("id", *same), classes, same, total).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
    roots = components(links.union(again))
    common.release(spark)
    out = marks.select("id", "n_shingles").join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = PIPELINE_WORDS, percent: int = PIPELINE_PERCENT) -> DataFrame:
    """docs with the smallest document of each group and all its columns; rows of one doc_id and text become one.

    Rows with a null doc_id stay, as do rows of the doc_id that is kept with another text: they are parts of one document.
    """
    told = groups(docs, "doc_id", words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("stays"), F.count("*").alias("times"))
    told = common.settle(told.where("not stays or times > 1").select(F.col("doc_id").cast("bigint").alias("id"), "stays", "times"), "told")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"))
    left = whole.join(told.where("not stays").select("id"), "id", "left_anti")
    again = told.where("stays and times > 1").select("id")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, "id", "left_anti").select("row.*")
    return once.union(left.join(again, "id", "left_semi").dropDuplicates(["id", "text"]).select("row.*"))

"""Nearest neighbours by largest inner product: vantage-point trees in every shard.

An inner product has no triangle inequality. With M above the norms of all rows, a row x
becomes (x, sqrt(M^2 - |x|^2)) and a query q of norm M becomes (q, 0); distances between
these order rows as inner products do. Rows of a shard whose norms share a power of two
make up one tree with an M of its own, so that one huge row spoils no other's distances.
A node splits its rows at the median distance from one of them; a query skips a node when
the triangle inequality puts all of it beyond FACTOR times the distance that its last
result so far stands for. Factor one gives exact search, less than one skips more.

Within a leaf rows are ranked by the exact inner product, then id, and whatever ties with
the last result stays in the running; rounding only widens what is looked at.

The trees are built once, a shard a row, and settled. Queries are packed into blocks of
BLOCK_NUMBERS; each block is one pass over the trees that is settled before the next, so
that no more than one block is ever with the driver.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors of other lengths than the query's are no candidates; repeated vec_ids
are rows of their own, each row of the queries gets its own results, and no row is a
neighbour of a query with its id.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

NEIGHBOURS, QUERY_EVERY = 20, 20
FACTOR = 1.0
#: Components that a shard and a query block hold at most.
SHARD_NUMBERS, BLOCK_NUMBERS = 2_000_000, 2_000_000
LEAF = 256
#: Queries that are compared with a leaf at a time.
TOGETHER = 256
#: Rows that are tried as a node's vantage point, and rows that each is tried on.
TRIED, TRIED_ON = 5, 100


def scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over a power of two, with norms from a half to one, and that power; no square overflows."""
    _, power = np.frexp(np.abs(rows).max(axis=1))
    small = np.ldexp(rows, -power[:, None])
    _, more = np.frexp(np.sqrt((small**2).sum(axis=1)))
    return np.ldexp(small, -more[:, None]), (power + more).astype(np.int64)


def augmented(small: np.ndarray) -> np.ndarray:
    """Rows of norms up to one with the component that makes their norms one."""
    return np.concatenate([small, np.sqrt(np.maximum(1 - (small**2).sum(axis=1), 0))[:, None]], axis=1)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


class Index:
    """Trees over the rows of a shard, as flat arrays; a node's rows lie together.

    Node columns: first row, end of rows, inner child, outer child (0 in leaves), power of
    two of the tree. Each node has its vantage point, and the least and greatest distance
    of its rows from its parent's.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        small, power = scaled(rows)
        points = augmented(small)
        order = np.argsort(-power, kind="stable")
        nodes: list[list[int]] = []
        vantage: list[np.ndarray] = []
        reach: list[tuple[float, float]] = []
        roots: list[int] = []
        cuts = np.flatnonzero(np.diff(power[order], prepend=power[order[0]] + 1)).tolist()
        open_ = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            roots.append(len(nodes))
            nodes.append([a, b, 0, 0, int(power[order[a]])])
            vantage.append(np.zeros(points.shape[1]))
            reach.append((0.0, np.inf))
            open_.append(len(nodes) - 1)
        while open_:
            k = open_.pop()
            a, b = nodes[k][:2]
            if b - a <= LEAF:
                continue
            own = order[a:b]
            centre, far = self._vantage(points, own)
            radius = float(np.median(far))
            inside = far <= radius
            if inside.all():  # more than half at the greatest distance
                inside = far < radius
                if not inside.any():
                    continue
            vantage[k] = centre
            middle = a + int(inside.sum())
            order[a:b] = np.concatenate([own[inside], own[~inside]])
            for child, (x, y, part) in enumerate(((a, middle, far[inside]), (middle, b, far[~inside]))):
                nodes[k][2 + child] = len(nodes)
                open_.append(len(nodes))
                nodes.append([x, y, 0, 0, nodes[k][4]])
                vantage.append(np.zeros(points.shape[1]))
                reach.append((float(part.min()), float(part.max())))
        self.ids, self.rows = ids[order], rows[order]
        self.nodes, self.vantage, self.reach, self.roots = np.array(nodes, np.int64), np.array(vantage), np.array(reach), np.array(roots, np.int64)

    @staticmethod
    def _vantage(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows the one whose distances spread most, and all distances from it."""
        some = points[own[:: -(-len(own) // TRIED_ON)]]
        tried = points[own[:: -(-len(own) // TRIED)]]
        best = max(range(len(tried)), key=lambda t: distances(some, tried[t]).std())
        return tried[best], distances(points[own], tried[best])

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpack(cls, body: bytes) -> Index:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(body), allow_pickle=False) as held:
            vars(self).update({name: held[name] for name in held.files})
        return self


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in one fixed order; undefined ones are least."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * b).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


class Search:
    """The nearest rows of one shard for a batch of queries, by score and then id."""

    def __init__(self, index: Index, ids: np.ndarray, queries: np.ndarray, want: int, factor: float) -> None:
        self.index, self.ids, self.queries, self.want, self.factor = index, ids, queries, want, factor
        small, self.power = scaled(queries)
        self.norm = np.sqrt((small**2).sum(axis=1))
        self.unit = small / self.norm[:, None]
        self.points = np.concatenate([self.unit, np.zeros((len(queries), 1))], axis=1)
        self.score = np.full((len(queries), want), -np.inf)
        self.found = np.full((len(queries), want), np.iinfo(np.int64).max)
        self.looked = 0
        #: What rounding may make of a product of two rows of norm one.
        self.margin = 1e-14 + 2e-15 * queries.shape[1]
        for root in index.roots.tolist():
            self._descend(root)

    def _least(self, who: np.ndarray, power: int) -> np.ndarray:
        """The product with a tree's scaled rows that a query's last result stands for."""
        last = self.score[who, -1]
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.ldexp(last / self.norm[who], -(self.power[who] + power))
        return np.where(np.isnan(out) | (last == np.inf), -np.inf, out)

    def _descend(self, root: int) -> None:
        nodes, reach = self.index.nodes, self.index.reach
        power = int(nodes[root][4])
        stack = [(root, np.arange(len(self.ids)), np.zeros(len(self.ids)))]
        while stack:
            k, who, far = stack.pop()
            if not len(who):
                continue
            # no row of the tree is longer than one, and none is nearer than the triangle inequality allows
            least = self._least(who, power)
            radius = np.sqrt(np.maximum(2 - 2 * np.maximum(least, -1), 0))
            low, high = reach[k]
            gap = np.maximum(np.maximum(low - far, far - high), 0)
            open_ = (least <= 1 + self.margin) & ((least < -1) | (gap <= self.factor * radius + 1e-6))
            who = who[open_]
            a, b, inner, outer, _ = nodes[k].tolist()
            if not inner:
                for x in range(a, b, LEAF):
                    for y in range(0, len(who), TOGETHER):
                        self._leaf(x, min(x + LEAF, b), who[y : y + TOGETHER], power)
                continue
            far = distances(self.points[who], self.index.vantage[k])
            near = far <= reach[inner][1]
            stack += [(outer, who[near], far[near]), (inner, who[~near], far[~near]), (outer, who[~near], far[~near]), (inner, who[near], far[near])]

    def _leaf(self, a: int, b: int, who: np.ndarray, power: int) -> None:
        if not len(who):
            return
        self.looked += len(who) * (b - a)
        rows, ids = self.index.rows[a:b], self.index.ids[a:b]
        like = self.unit[who] @ np.ldexp(rows, -power).T
        like[ids[None, :] == self.ids[who, None]] = -np.inf
        least = self._least(who, power)
        if b - a > self.want:
            least = np.maximum(least, np.partition(like, b - a - self.want, axis=1)[:, b - a - self.want])
        q, r = np.nonzero((like >= (least - self.margin)[:, None]) & (like > -np.inf))
        if not len(q):
            return
        new = product(rows[r], self.queries[who[q]])
        met = np.unique(q)
        # what was held and what is new, by query, score and id
        owner = np.concatenate([q, np.repeat(met, self.want)])
        score = np.concatenate([new, self.score[who[met]].ravel()])
        found = np.concatenate([ids[r], self.found[who[met]].ravel()])
        order = np.lexsort([found, -score, owner])
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = place < self.want
        self.score[who[owner[top]], place[top]] = score[order][top]
        self.found[who[owner[top]], place[top]] = found[order][top]


def _gathered(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, about numbers components together; vectors of one length."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), max(1, numbers // size)):
                part = at[k : k + max(1, numbers // size)]
                mine = held.setdefault(size, ([], []))
                mine[0].append(ids[part])
                mine[1].append(flat[cuts[part][:, None] + np.arange(size)])
                if sum(len(x) for x in mine[0]) * size >= numbers:
                    yield np.concatenate(mine[0]), np.concatenate(mine[1])
                    del held[size]
    for ids_, rows in held.values():
        yield np.concatenate(ids_), np.concatenate(rows)


def _row(size: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([body], pa.binary())], names=["size", "body"])


def _index(batches: Iterator[pa.RecordBatch], numbers: int, want: int) -> Iterator[pa.RecordBatch]:
    for ids, rows in _gathered(batches, numbers):
        # of equal vectors the smallest ids are all that a result can hold, and one more as a query leaves its own out
        _, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.lexsort([ids, which.ravel()])
        group = which.ravel()[order]
        own = ids[order]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
        # rows of one id are left out together, so ids are counted, and a repeated id as often as a result can show it
        distinct = np.cumsum(fresh) - 1
        begin = np.searchsorted(group, group)
        repeat = np.arange(len(order)) - np.flatnonzero(fresh)[distinct]
        keep = order[(distinct - distinct[begin] <= want) & (repeat < want)]
        yield _row(rows.shape[1], Index(ids[keep], rows[keep]).pack())


def _ask(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[pa.RecordBatch]:
    for ids, rows in _gathered(batches, numbers):
        out = io.BytesIO()
        np.savez(out, ids=ids, rows=rows)
        yield _row(rows.shape[1], out.getvalue())


def _search(batches: Iterator[pa.RecordBatch], block, want: int, factor: float) -> Iterator[pa.RecordBatch]:
    with np.load(io.BytesIO(block.value), allow_pickle=False) as asked:
        ids, queries = asked["ids"], asked["rows"]
    for batch in batches:
        for body in batch.column("body"):
            search = Search(Index.unpack(body.as_py()), ids, queries, want, factor)
            q, k = np.nonzero(search.found < np.iinfo(np.int64).max)
            names = ["q", "query_id", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(search.found[q, k]), pa.array(search.score[q, k])], names=names)


def search(vectors: DataFrame, queries: DataFrame, want: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the nearest rows of vectors with another id."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        held = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        return held.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))

    packed = "size bigint, body binary"
    shard, asked = SHARD_NUMBERS, BLOCK_NUMBERS
    trees = common.settle(usable(vectors).mapInArrow(lambda it: _index(it, shard, want), packed), "trees")
    blocks = common.settle(usable(queries).mapInArrow(lambda it: _ask(it, asked), packed), "queries")
    found = None
    for row in blocks.toLocalIterator():
        sent = spark.sparkContext.broadcast(bytes(row.body))
        one = trees.where(F.col("size") == row.size).mapInArrow(lambda it, sent=sent: _search(it, sent, want, factor), "q bigint, query_id bigint, vec_id bigint, score double")
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        one = common.settle(one.withColumn("rank", best).where(F.col("rank") <= want), "neighbours")
        sent.destroy()
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))

"""Benchmark decontamination by suffix arrays over the training texts.

Each chunk of documents is a shard with a suffix array of its words. Every suffix of
every benchmark item is binary-searched in it; a range of the array whose suffixes
agree with it over a whole window gives the occurrences, and occurrences that follow
one another on one diagonal make up the longest verbatim match.

The array is sparse: a training suffix is left out only if no benchmark window begins
with its first words, so nothing that a search could find is missing.

Suffixes are compared to the length of a window, and longer matches are put together
from windows. The benchmark goes to the workers in blocks of about BLOCK_BYTES of text. Each
block is a further narrow pass that adds to what the passes before it found; after
BLOCKS_AT_ONCE of them the rows are settled and the blocks let go, so memory does not grow
with the benchmark. Documents are never shuffled.

Defined results: null or empty text has no words and no hit; a null item_id marks words
but is not listed; repeated rows each get their own result; an empty benchmark hits
nothing. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Words that a window has; an item of fewer words is one window.
WINDOW = 10
#: Benchmark text, in bytes, that one pass over the documents carries.
BLOCK_BYTES = 2_000_000
#: Blocks that workers hold at a time.
BLOCKS_AT_ONCE = 4
#: Words by which training suffixes are chosen for the array.
LEAD = 3

_SPANS = "array<struct<start:bigint,end:bigint>>"
_MATCHES = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


class Windows:
    """The distinct windows of a block of benchmark items, by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        self.names = sorted({i for i, _ in items if i is not None})
        place = {n: k for k, n in enumerate(self.names)}
        data, offsets = common.text_bytes(pa.array([t or "" for _, t in items], pa.string()))
        starts, ends, owner = common.find_words(data, offsets, common.ALNUM)
        words = common.word_hashes(data, starts, ends)
        first = np.searchsorted(owner, np.arange(len(items) + 1))
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for k, (name, _) in enumerate(items):
            n = int(first[k + 1] - first[k])
            size = min(window, n)
            for at in range(n - size + 1 if n else 0):
                by_length.setdefault(size, []).append((int(first[k]) + at, place.get(name, -1), at))
        self.groups = []
        lead: list[np.ndarray] = []
        for size, found in sorted(by_length.items()):
            at = np.array([x[0] for x in found])
            rows = words[at[:, None] + np.arange(size)]
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            holder = np.array([x[1] for x in found])[order]
            offset = np.array([x[2] for x in found])[order]
            cuts = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
            self.groups.append((size, distinct, cuts, holder, offset))
            lead.append(gram(rows, min(LEAD, size)))
        self.short = any(g[0] < LEAD for g in self.groups)
        self.lead = {}
        for (size, *_), hashes in zip(self.groups, lead):
            bits = self.lead.setdefault(min(LEAD, size), np.zeros(1 << 20, bool))
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True


def gram(rows: np.ndarray, size: int) -> np.ndarray:
    """One hash of the first size columns."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = common.mix(out * np.uint64(31) + rows[:, k])
    return out


def suffix_array(words: np.ndarray, owner: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a window may begin at, in the order of their suffixes, and the suffixes' leading words.

    A suffix ends with its document; 0, which is no word's hash, stands for what lies beyond.
    """
    n, size = len(words), windows.window
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    keep = np.zeros(n, bool)
    for length, bits in windows.lead.items():
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                out = common.mix(out * np.uint64(31) + padded[k : n + k])
        keep |= bits[(out >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(keep)
    reach = at[:, None] + np.arange(size)
    rows = padded[reach]
    last = np.concatenate([owner, np.full(size, -1)])
    rows[last[reach] != owner[at][:, None]] = 0
    order = np.lexsort(rows.T[::-1]) if len(at) else np.empty(0, np.int64)
    return at[order], rows[order]


def search(rows: np.ndarray, sought: np.ndarray, after: bool) -> np.ndarray:
    """Binary search for every sought row at once: how many suffixes lie before it (after: or begin with it)."""
    low = np.zeros(len(sought), np.int64)
    high = np.full(len(sought), len(rows), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        have = rows[np.minimum(mid, len(rows) - 1), : sought.shape[1]]
        differ = have != sought
        column = differ.argmax(axis=1)
        pick = np.arange(len(sought))
        less = np.where(differ.any(axis=1), have[pick, column] < sought[pick, column], after)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def occurrences(words: np.ndarray, owner: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: size, word positions, their windows, and the group's cuts, holders and offsets."""
    if not windows.groups or not len(words):
        return
    at, rows = suffix_array(words, owner, windows)
    if not len(at):
        return
    for size, distinct, cuts, holder, offset in windows.groups:
        low, high = search(rows, distinct, False), search(rows, distinct, True)
        counts = high - low
        which = np.repeat(np.arange(len(distinct)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        yield size, at[np.repeat(low, counts) + inside], which, cuts, holder, offset


def _scan(batches: Iterator[pa.RecordBatch], windows, want: bool, last: bool) -> Iterator[pa.RecordBatch]:
    block = windows.value
    for batch in common.chunks(batches):
        data, offsets = common.text_bytes(batch.column("text"))
        starts, ends, owner = common.find_words(data, offsets, common.ALNUM)
        words = common.word_hashes(data, starts, ends)
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        touched: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        matches: dict[int, list[tuple]] = {}
        for size, at, which, cuts, holder, offset in occurrences(words, owner, block):
            pair = np.unique(np.stack([owner[at], which]), axis=1)
            for d, w in pair.T.tolist():
                items.setdefault(d, set()).update(holder[cuts[w] : cuts[w + 1]].tolist())
            position = np.sort(at)
            for p in position.tolist():
                spans = touched.setdefault(int(owner[p]), [])
                local = p - int(first[owner[p]])
                spans.append((local, local + size))
            if want:
                _diagonals(size, at, which, cuts, holder, offset, owner, first, block, matches)
        old_spans = batch.column("spans").to_pylist()
        old_items = batch.column("items").to_pylist()
        spans_out, items_out = [], []
        for d in range(batch.num_rows):
            spans = [(s["start"], s["end"]) for s in old_spans[d] or []]
            spans_out.append([{"start": s, "end": e} for s, e in _merge(spans + touched.get(d, []))])
            named = {block.names[i] for i in items.get(d, ()) if i >= 0}
            items_out.append(sorted(named | set(old_items[d] or [])))
        out = {name: batch.column(name) for name in batch.schema.names}
        if last:
            out["text"] = pa.nulls(batch.num_rows, pa.string())
        out["n_words"] = pa.array(np.diff(first).astype(np.int64))
        out["spans"] = pa.array(spans_out, batch.schema.field("spans").type)
        out["items"] = pa.array(items_out, batch.schema.field("items").type)
        if want:
            before = batch.column("matches").to_pylist()
            out["matches"] = pa.array([(before[d] or []) + [dict(zip(("item_id", "doc_word", "item_word", "n_words"), m)) for m in sorted(matches.get(d, []), key=str)] for d in range(batch.num_rows)], batch.schema.field("matches").type)
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _diagonals(size, at, which, cuts, holder, offset, owner, first, block, matches) -> None:
    """Joins window occurrences that follow one another in document and item to their longest match."""
    counts = (cuts[1:] - cuts[:-1])[which]
    reps = np.repeat(np.arange(len(at)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    slot = np.repeat(cuts[which], counts) + inside
    doc, item, low = owner[at][reps], holder[slot], offset[slot]
    word = at[reps] - first[doc]
    order = np.lexsort([low, word - low, item, doc])
    run: list[int] | None = None
    for d, i, w, o in zip(doc[order].tolist(), item[order].tolist(), word[order].tolist(), low[order].tolist()):
        if run and run[:2] == [d, i] and w - o == run[2] - run[3] and o <= run[3] + run[4] - size + 1:
            run[4] = o - run[3] + size
            continue
        if run:
            matches.setdefault(run[0], []).append((block.names[run[1]] if run[1] >= 0 else None, run[2], run[3], run[4]))
        run = [d, i, w, o, size]
    if run:
        matches.setdefault(run[0], []).append((block.names[run[1]] if run[1] >= 0 else None, run[2], run[3], run[4]))


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark, partition by partition, in blocks of bounded text."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        n = len((row.text or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.text or ""))
        size += n
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, matches: bool = False) -> DataFrame:
    """One row per document: id_col, n_words, spans of hit words, items, and, if asked, the longest matches."""
    spark = docs.sparkSession
    out = docs.select(
        F.col(id_col).alias("id"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast(_SPANS).alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
        *([F.lit(None).cast(_MATCHES).alias("matches")] if matches else []),
    )
    held = []
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        if len(held) == BLOCKS_AT_ONCE:
            out = common.settle(out, "scanned")
            for old in held:
                old.destroy()
            held = []
        held.append(spark.sparkContext.broadcast(Windows(block, window)))
        out = out.mapInArrow(lambda it, sent=held[-1], last=following is None: _scan(it, sent, matches, last), out.schema)
        block = following
    return out.drop("text").withColumnRenamed("id", id_col)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """id_col, item_id, doc_word, item_word and n_words of every longest verbatim match of a window or more."""
    found = scan(docs, benchmark, id_col, window, matches=True)
    return found.select(id_col, F.explode("matches").alias("m")).select(id_col, "m.*")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, and the items whose windows occur, as a digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return scan(docs, benchmark, id_col).select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns.

    The whole row goes through the scan as one struct, so no join by id is needed and rows with equal or null ids keep their own verdict.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return scan(whole, benchmark, "row", window).where(F.size("spans") == 0).select("row.*")

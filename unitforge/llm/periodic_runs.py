"""Runs of periodically repeated words, by a grid of longest common extensions.

A run of period p and at least TIMES * p words holds TIMES neighbouring points of the grid 0, p, 2p, ..., where its words are equal.
For each period p and pair of neighbours jp, (j+1)p the longest common extension forwards and backwards tells how far period p reaches
to both sides; it is the minimum of a range of common prefixes in a suffix array of the words, or of the words reversed. Grid points
whose words differ from the next ones' are left out before, since no such run starts there; texts without any need no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, TIMES = 6, 4
#: Bytes of text, words in a suffix array and pairs of grid points that are worked on at once; a longer text goes alone.
SLICE, WORDS, PAIRS = 1 << 22, 1 << 17, 1 << 20
#: Suffixes of a block of the range-minimum table.
BLOCK = 16
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


class Extensions:
    """Longest common extensions of a sequence of codes: suffix array by doubled prefixes, common prefixes, range minima over blocks.

    Memory is linear but for the ranks of each doubling, which go when the common prefixes are known: 4 bytes a code for each bit of the
    longest repeated stretch.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
        step = 1
        while levels[-1].max(initial=0) < n - 1:
            rank = levels[-1].astype(np.int64)
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            pair = rank * (n + 1) + after
            order = np.argsort(pair)
            new = np.empty(n, np.int32)
            new[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
            levels.append(new)
            step *= 2
        self.rank = levels.pop()
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            level, inside = levels.pop(), np.flatnonzero(np.maximum(a, b) + (1 << k) <= n)
            same = inside[level[a[inside]] == level[b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
        common[1:] = a - order[:-1]
        pad = -n % BLOCK
        blocks = np.concatenate((common, np.full(pad, np.iinfo(np.int32).max, np.int32))).reshape(-1, BLOCK)
        self.n, self.common = n, blocks.ravel()
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, elementwise; i and j differ."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        low = np.minimum(self.right[a], self.left[b])
        one = np.flatnonzero(first == last)
        if len(one):
            x, y = a[one], b[one]
            own = self.common[x]
            for _ in range(BLOCK - 1):
                x = np.minimum(x + 1, y)
                own = np.minimum(own, self.common[x])
            low[one] = own
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            x, width = first[wide] + 1, last[wide] - first[wide] - 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                table = self.table[k]
                low[wide[at]] = np.minimum(low[wide[at]], np.minimum(table[x[at]], table[x[at] + width[at] - (1 << int(k))]))
        return low.astype(np.int64)


def grid_pairs(codes: np.ndarray, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, j) of grid points whose word stands at the next times - 1 points too, in parts of about PAIRS; all periods up to len / times.

    Short periods are taken one by one, long ones together for each j.
    """
    n = len(codes)
    far, root = times - 1, int(n**0.5)
    held, count = [], 0
    for p in range(1, min(root, n // times) + 1):
        grid = codes[::p]
        same = grid[1:] == grid[:-1]
        m = len(grid) - far
        fits = same[:m].copy()
        for t in range(1, far):
            fits &= same[t : t + m]
        j = np.flatnonzero(fits)
        if len(j):
            held.append((np.full(len(j), p), j))
            count += len(j)
            if count >= PAIRS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
    for j in range(n // (root + 1) + 1):
        p = np.arange(root + 1, min(n // times, (n - 1) // (j + far)) + 1)
        for t in range(far):
            if not len(p):
                break
            p = p[codes[(j + t) * p] == codes[(j + t + 1) * p]]
        if len(p):
            held.append((p, np.full(len(p), j)))
            count += len(p)
            if count >= PAIRS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) by start and end, of equal stretches that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def _stretches(offset: int, pairs: tuple[np.ndarray, np.ndarray], forward: Extensions, backward: Extensions, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of the runs through grid points of a text that stands at offset."""
    p, j = pairs
    i = offset + j * p
    start = i - backward(backward.n - i, backward.n - i - p) - offset
    end = i + p + forward(i, i + p) - offset
    long = end - start >= np.maximum(least, times * p)
    return _distinct(np.stack((start[long], end[long], p[long]), axis=1))


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each sequence of codes: rows (start, length, period) by start and period, with length >= max(least, times * period).

    A stretch that several periods fit has the smallest alone: by the theorem of Fine and Wilf it divides the others, and gets the same
    stretch. Texts with grid points that repeat share a suffix array while they have WORDS words together; none extends into another.
    """
    if times < 3:
        raise ValueError("a grid of periods needs three repetitions or more")
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    batch: list[tuple[int, tuple, Iterator]] = []

    def settle() -> None:
        codes, offsets, word = [np.array([0])], [], len(batch) + 1
        for place, (i, _, _) in enumerate(batch):
            offsets.append(sum(map(len, codes)))
            codes += [texts[i].astype(np.int64) + word, np.array([place + 1])]  # a break has a code of its own
        whole = np.concatenate(codes)
        forward, backward = Extensions(whole), Extensions(whole[::-1])
        for offset, (i, pairs, more) in zip(offsets, batch, strict=True):
            found = _stretches(offset, pairs, forward, backward, least, times)
            for pairs in more:
                found = _distinct(np.concatenate((found, _stretches(offset, pairs, forward, backward, least, times))))
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            out[i] = np.stack((found[:, 0], found[:, 1] - found[:, 0], found[:, 2]), axis=1)
        batch.clear()

    for i, codes in enumerate(texts):
        more = grid_pairs(codes, times)
        pairs = next(more, None)
        if pairs is None:
            continue
        if batch and sum(len(texts[k]) for k, _, _ in batch) + len(codes) > WORDS:
            settle()
        batch.append((i, pairs, more))
    if batch:
        settle()
    return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, words): the code of every word of all texts, where each text's codes begin and end, and the words by code."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_BREAK[raw]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    new[first] = inside[first]
    starts = np.flatnonzero(new)
    place = np.concatenate(([0], np.cumsum(inside)))
    offsets = place[np.append(starts, len(raw))].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, ends), coded.dictionary


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that stay: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes together; a longer text is one."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
        yield at, to
        at = to


def _columns(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.columns[-1]):
                part = batch.slice(a, b - a)
                codes, bounds, words = split_words(part.columns[-1])
                texts = [codes[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
                runs = find_runs(texts, least, times)
                keep = np.concatenate([np.zeros(0, bool), *(_kept(len(t), r) if len(r) else np.ones(len(t), bool) for t, r in zip(texts, runs, strict=True))])
                cut = np.concatenate(([0], np.cumsum(keep)))[bounds]
                lists = pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), words.take(pa.array(codes[keep])))
                joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.string())
                rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
                found = pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], ["start", "length", "period"])
                ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, found), joined], [*part.schema.names[:-1], "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Columns keep of docs, runs (array of start, length, period; by start, then period) and collapsed (the words outside repetitions).

    Words are the stretches without \\x20 and \\x09-\\x0D. A run is a stretch of words with smallest period p that no neighbouring word
    extends with that period, and has max(least, times * p) words or more; times is three or more. collapsed is the text's words without
    those of runs after their first p, joined by single spaces. A null or empty text has no runs and collapses to the empty text. Every row
    gives one row, repeated ones too, in its own task: nothing is shuffled. A column of keep called runs or collapsed is replaced; other
    columns are not read. An empty table gives an empty one. A task needs about 40 to 150 bytes for each word of its longest text.
    """
    keep = [c for c in keep if c not in ("runs", "collapsed")]
    name = "text"
    while name in keep:
        name = f"_{name}"
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(name))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = T.StructType([*(rows.schema[c] for c in keep), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_columns(least, times), out)

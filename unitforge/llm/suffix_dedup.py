"""Exact-substring deduplication with sharded suffix arrays.

A string of `least` bytes that two documents share makes both choose the same minimizer (the window's smallest hash of GRAM bytes).
Minimizers of one document only are left out; the windows around the others, as fragments, are dealt into shards by their
minimizer, so that equal strings meet in one shard. There a suffix array sorts all fragments: suffixes are classified, leftmost-smaller
substrings are sorted and named, their order is found recursively, and the rest is induced in two linear passes over the buckets, each
done in whole bucket slices. Permuted common prefixes then tell runs of equal windows, and every window learns the smallest
document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

GRAM = 20
#: Buckets of alphabets beyond FEW are induced in about so many blocks of neighbouring buckets, each in rounds of whole slices.
FEW, BLOCKS = 300, 16
SHARD_BYTES = 1 << 20
#: Texts and bytes that are worked on at once; a longer text goes alone.
SLICE, CHUNK = 2048, 1 << 18
#: Bits of a minimizer's code, and what is set in one that very many documents hold.
CODE, HOT = (1 << 48) - 1, 1 << 60
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S-type); the last, a sentinel, is."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate((np.append(step, 1)[following] > 0, [True]))


def _deal(to: np.ndarray, chars: np.ndarray, values: np.ndarray, ends: np.ndarray, way: int) -> None:
    """Put values into their characters' buckets in the given order, upwards or downwards from ends, which move on."""
    order = np.argsort(chars, kind="stable")
    c, v = chars[order], values[order]
    new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    size = np.diff(np.append(new, len(c)))
    own = np.arange(len(c)) - np.repeat(new, size)
    to[ends[c] + way * own] = v
    ends[c[new]] += way * size


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _blocks_of(s: np.ndarray, k: int) -> list[int]:
    """Borders of blocks of buckets with about equally many suffixes; a character of long runs has a block of its own.

    A block takes as many rounds as its longest chain of suffixes that induce each other, which such runs would make long.
    """
    if k <= FEW:
        return list(range(k + 1))
    mass = np.cumsum(np.bincount(s, minlength=k))
    run = s[:-1] == s[1:]
    for step in (1, 2, 4):  # eight in a row
        run = run[:-step] & run[step:]
    again = np.unique(s[: len(run)][run]).astype(np.int64)
    borders = np.flatnonzero(np.diff(mass * BLOCKS // (len(s) + 1))) + 1
    return np.unique(np.concatenate(([0, 1, k], borders, again, again + 1))).tolist()


def _rounds(scanned: np.ndarray, keys: np.ndarray, given: np.ndarray, order: np.ndarray, s: np.ndarray, takes: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that belong into a block in the order of the scan, and those before them that belong into later blocks.

    given, in order of their keys `order`, came from earlier blocks; scanned, with their keys, are read too but don't belong to the
    buckets that are filled. takes tells which suffixes are induced; key gives the place of a character's bucket within the block, and
    a negative number outside of it. Rounds go on until no suffix of the block moves any more.
    """
    own, at = given, order
    while True:
        every, place = np.concatenate((own, scanned)), np.concatenate((2 * at, 2 * keys + 1))
        every = every[np.argsort(place, kind="stable")]
        before = every[every > 0] - 1
        before = before[takes[before]]
        to = key(s[before])
        inside = to >= 0
        new, place = np.concatenate((given, before[inside])), np.concatenate((order, to[inside]))
        by = np.argsort(place, kind="stable")
        new, place = new[by], place[by]
        if len(new) == len(own) and (new == own).all():
            return own, before[~inside]
        own, at = new, place


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order induced from the given order of LMS suffixes: the L-type and the S-type suffixes, each by bucket."""
    chars = s[lms]
    lms = lms[np.argsort(chars, kind="stable")]
    lms_end = np.cumsum(np.bincount(chars, minlength=k))
    count_l, count_s = np.bincount(s[~smaller], minlength=k), np.bincount(s[smaller], minlength=k)
    end_l, end_s = np.cumsum(count_l), np.cumsum(count_s)
    large, small = np.empty(end_l[-1], dtype=np.int64), np.empty(end_s[-1], dtype=np.int64)
    head = end_l - count_l
    start = head.copy()
    borders, larger = _blocks_of(s, k), ~smaller
    for c, to in zip(borders, borders[1:], strict=False):
        own = lms[lms_end[c - 1] if c else 0 : lms_end[to - 1]]
        if to - c > 1:
            came = head[c:to] - start[c:to]
            given, order = large[_ranges(start[c:to], came)], np.repeat(np.arange(to - c), came)
            filled, before = _rounds(own, s[own].astype(np.int64) - c, given, order, s, larger, lambda x, c=c, to=to: np.where(x < to, x.astype(np.int64) - c, -1))
            large[_ranges(start[c:to], count_l[c:to])] = filled
            head[c:to] = end_l[c:to]
            if len(before):
                _deal(large, s[before], before, head, 1)
            continue
        at, to, out = int(start[c]), int(head[c]), []
        while at < to:  # a round more for each repetition of the character
            run, at = large[at:to], to
            before = run[run > 0] - 1
            before = before[larger[before]]
            same = s[before] == c
            again = before[same]
            large[to : to + len(again)] = again
            to += len(again)
            out.append(before[~same])
        head[c] = to
        out.append(own[own > 0] - 1)
        before = np.concatenate(out)
        if len(before):
            _deal(large, s[before], before, head, 1)
    tail = end_s - 1
    for c, to in zip(borders[-2::-1], borders[:0:-1], strict=True):
        if not c:
            small[tail[0]] = len(s) - 1  # the sentinel, alone in its block
            tail[0] -= 1
        if to - c > 1:
            came, down = (end_s[c:to] - 1 - tail[c:to])[::-1], slice(c, to)
            given, order = small[-_ranges(-(end_s[down][::-1] - 1), came)], np.repeat(np.arange(to - c), came)
            own = large[start[c] : end_l[to - 1]][::-1]
            filled, before = _rounds(own, to - 1 - s[own].astype(np.int64), given, order, s, smaller, lambda x, c=c, to=to: np.where(x >= c, to - 1 - x.astype(np.int64), -1))
            small[-_ranges(-(end_s[down][::-1] - 1), count_s[down][::-1])] = filled
            tail[down] = end_s[down] - count_s[down] - 1
            if len(before):
                _deal(small, s[before], before, tail, -1)
            continue
        at, to, out = int(end_s[c]) - 1, int(tail[c]), []
        while at > to:
            run, at = small[to + 1 : at + 1][::-1], to
            before = run[run > 0] - 1
            before = before[smaller[before]]
            same = s[before] == c
            again = before[same]
            small[to + 1 - len(again) : to + 1] = again[::-1]
            to -= len(again)
            out.append(before[~same])
        tail[c] = to
        own = large[start[c] : end_l[c]][::-1]
        before = own[own > 0] - 1
        out.append(before[smaller[before]])
        before = np.concatenate(out)
        if len(before):
            _deal(small, s[before], before, tail, -1)
    return large, small


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s over 0..k-1, whose last character is its only 0.

    Leftmost-smaller substrings are named, and the string of names is sorted by the same way again, whatever its alphabet.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    s = s.astype(np.uint16 if k <= 65536 else np.int64)
    smaller = _is_smaller(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    _, small = _induce(s, smaller, lms, k)
    first = np.zeros(n, dtype=bool)
    first[lms] = True
    ordered = small[first[small]]  # by leftmost-smaller substrings
    end = np.append(lms[1:], n - 1)
    length = np.zeros(n, dtype=np.int64)
    length[lms] = end - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    alive, at = np.flatnonzero(same), 0
    while len(alive):
        alive = alive[at < length[a[alive]]]
        differs = s[a[alive] + at] != s[b[alive] + at]
        same[alive[differs]] = False
        alive, at = alive[~differs], at + 1
    name = np.zeros(n, dtype=np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    names = name[lms]
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        ranked = np.empty(len(lms), dtype=np.int64)
        ranked[names] = np.arange(len(lms))
    else:
        ranked = suffix_array(names, kinds)
    large, small = _induce(s, smaller, lms[ranked], k)
    count_l, count_s = np.bincount(s[~smaller], minlength=k), np.bincount(s[smaller], minlength=k)
    shift_l, shift_s = np.cumsum(count_s) - count_s, np.cumsum(count_l)
    out = np.empty(n, dtype=np.int64)
    out[np.arange(len(large)) + np.repeat(shift_l, count_l)] = large
    out[np.arange(len(small)) + np.repeat(shift_s, count_s)] = small
    return out


def long_prefixes(raw: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """In text order: has each suffix a common prefix of at least `least` characters with the one before it in the suffix array?

    The permuted common prefixes, cut at least: compared in text order, four characters (of 16 bits) a step, while they agree. least is
    4 or more.
    """
    n = len(raw)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    four = np.zeros(n, dtype=np.uint64)
    for j in range(4):
        four[: n - j] |= raw[j:].astype(np.uint64) << np.uint64(16 * j)
    at = np.flatnonzero((before >= 0) & (np.arange(n) + least <= n) & (before + least <= n))
    for j in [*range(0, least - 4, 4), least - 4]:
        at = at[four[at + j] == four[before[at] + j]]
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


def smallest_holders(raw: np.ndarray, sizes: np.ndarray, lowest: np.ndarray, least: int) -> list[np.ndarray]:
    """For every window of `least` bytes of each fragment: the smallest document among the fragments that hold it.

    raw: the fragments' bytes one after the other; lowest: each one's smallest document.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    s = np.full(ends[-1] + 1, 1, dtype=np.uint16)
    s[np.arange(len(raw)) + owner] = raw.astype(np.uint16) + 2
    s[-1] = 0
    order = suffix_array(s, 258)[1:]
    inside = np.zeros(len(s) - 1, dtype=bool)
    inside[_ranges(starts, sizes - least + 1)] = True
    order = order[inside[order]]
    fresh = ~long_prefixes(s[:-1], order, least)[order]
    fresh[:1] = True
    group = np.flatnonzero(fresh)
    low = np.minimum.reduceat(lowest[np.searchsorted(ends, order, side="right")], group)
    holder = np.empty(len(s) - 1, dtype=np.int64)
    holder[order] = np.repeat(low, np.diff(np.append(group, len(order))))
    return [holder[a : a + n] for a, n in zip(starts.tolist(), (sizes - least + 1).tolist(), strict=True)]


# --- minimizers and fragments ----------------------------------------------------------------------------------------


def _grams(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of `width` bytes, put together from those of powers of two."""
    h, span, parts, done = _BYTE[raw], 1, None, 0
    while span <= width:
        if width & span:
            piece = h[done:] if done else h
            if parts is None:
                parts = piece
            else:
                m = min(len(parts), len(piece))
                parts = parts[:m] * np.uint64(pow(_BASE, span, 1 << 64)) + piece[:m]
            done += span
        h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    g = parts[: len(raw) - width + 1]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(29))


def _hashes(raw: np.ndarray, least: int) -> np.ndarray:
    """The smallest hash of GRAM bytes in each window of `least` bytes; raw holds `least` bytes or more."""
    width, m, span = least - GRAM + 1, _grams(raw, GRAM), 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    windows = len(raw) - least + 1
    return np.minimum(m[:windows], m[width - span : width - span + windows])


def may_share(raw: np.ndarray, sizes: np.ndarray, codes: np.ndarray, least: int) -> np.ndarray:
    """Which fragments can have a window in common with another one; raw: their bytes one after the other; codes: their minimizers'.

    Every window around a minimizer reaches half of what is not minimizer to its left or to its right at least. A fragment whose
    strings of that reach, to either side, are no other fragment's has no window in common with any. Fragments that hold their
    minimizer more than once count as such that can.
    """
    side = (least - GRAM + 1) // 2
    ends = np.cumsum(sizes)
    grams = (_grams(raw, GRAM) & np.uint64(CODE)).astype(np.int64)
    at = np.flatnonzero(grams == np.repeat(codes, sizes)[: len(grams)])
    own = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[own]
    at, own = at[inside], own[inside]
    out = np.bincount(own, minlength=len(sizes)) != 1
    once = ~out[own]
    at, own = at[once], own[once]
    wide = _grams(raw, GRAM + side) if len(raw) >= GRAM + side else np.zeros(0, np.uint64)
    left, right = at - side >= (ends - sizes)[own], at + GRAM + side <= ends[own]
    values = np.concatenate((wide[at[left] - side], ~wide[at[right]]))
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    out[np.concatenate((own[left], own[right]))[count[inverse] > 1]] = True
    return out


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(codes), dtype=bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def minimizers(raw: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, text, first window, last window + 1) of each run of windows with the same minimizer, for texts that end at `ends` of raw.

    Windows lie within a text; positions are those of raw.
    """
    if len(raw) < least:
        return (np.zeros(0, np.int64),) * 4
    m = _hashes(raw, least)
    inside = np.repeat(ends, np.diff(ends, prepend=0))[: len(m)] >= np.arange(least, len(m) + least)
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (inside[1:] != inside[:-1]))))
    last = np.append(new[1:], len(m))
    own = inside[new]
    first = new[own]
    code = (m[first] & np.uint64(CODE)).astype(np.int64)
    return code, np.searchsorted(ends, first, side="right"), first, last[own]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column's texts one after the other, and where each begins, the end included."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, starts with the end) of parts of a column with about CHUNK bytes each; a text is never cut."""
    raw, at = _bytes_of(column)
    row = 0
    while row < len(column):
        to = max(row + 1, min(row + SLICE, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1))
        yield row, to, raw[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def _codes(least: int):
    """Distinct minimizers of each document, a row each: for the sample that finds very common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in _chunks(batch.column(0)):
                code, row, _, _ = minimizers(raw, at[1:], least)
                own = np.unique(row << 48 | code) & CODE
                yield pa.RecordBatch.from_arrays([pa.array(own)], names=["code"])

    return run


def _packed(least: int, buckets: int, common: np.ndarray):
    """(bucket, codes, documents): a chunk's distinct minimizers as packed arrays, in the documents' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts = []
            for a, _, raw, at in _chunks(batch.column(1)):
                code, row, _, _ = minimizers(raw, at[1:], least)
                own = np.unique(row << 48 | code)
                code = own & CODE
                keep = ~_among(code, common)
                parts.append((code[keep], ids[a + (own >> 48)[keep]]))
            if not parts:
                continue
            code, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = (code % buckets).astype(np.int32)
            order = np.argsort(at.astype(np.uint16) if buckets <= 65536 else at, kind="stable")
            at, code, doc = at[order], code[order], doc[order]
            cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
            six = code.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
            codes, docs = [], []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=False):
                codes.append(six[a:b].tobytes())
                step = np.diff(doc[a:b], prepend=0)
                docs.append(step.astype("<i4").tobytes() if np.abs(step).max() < 1 << 31 else b"L" + step.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts]), pa.array(codes, pa.binary()), pa.array(docs, pa.binary())], names=["bucket", "codes", "docs"])

    return run


def _shared(crowd: int):
    """(id, code) of the minimizers that more than one row of the partition's buckets holds; HOT is set in those of over `crowd` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for c, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wide = np.zeros((len(c) // 6, 8), dtype=np.uint8)
                wide[:, :6] = np.frombuffer(c, dtype=np.uint8).reshape(-1, 6)
                codes.append(wide.reshape(-1).view("<i8"))
                docs.append(np.cumsum(np.frombuffer(d[1:], "<i8") if len(d) % 4 else np.frombuffer(d, "<i4").astype(np.int64)))
        code, doc = np.concatenate(codes), np.concatenate(docs)
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(code)))
        many = np.repeat(size, size)
        code, doc = np.where(many > crowd, code | HOT, code)[many > 1], doc[many > 1]
        for a in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + (1 << 16)]), pa.array(code[a : a + (1 << 16)])], names=["id", "code"])

    return run


def _slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """raw[start : start + size] of each as binary values."""
    offsets, data = np.concatenate(([0], np.cumsum(size))), raw[_ranges(start, size)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _fragments(least: int, common: np.ndarray):
    """(hot, code, fragment, id, v, at): the windows around a document's shared minimizers; hot marks those around common ones."""
    names = ["hot", "code", "fragment", "id", "v", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            listed = batch.column(2)
            known = listed.flatten().to_numpy()
            lists = np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy())))
            for a, b, raw, at in _chunks(batch.column(1)):
                code, row, first, last = minimizers(raw, at[1:], least)
                own = known[lists[a] : lists[b]]
                key = np.repeat(np.arange(b - a), np.diff(lists[a : b + 1])) << 48 | (own & ~HOT)
                order = np.argsort(key)
                key, own = key[order], own[order]
                hot = _among(code, common)
                some = hot
                if len(key):
                    place = np.minimum(np.searchsorted(key, row << 48 | code), len(key) - 1)
                    found = key[place] == (row << 48 | code)
                    some, hot = hot | found, hot | (found & (own[place] & HOT > 0))
                code, row, first, last, hot = code[some], row[some], first[some], last[some], hot[some]
                columns = [pa.array(hot), pa.array(code), _slices(raw, first, last - 1 + least - first), pa.array(ids[a + row]), pa.array(kinds[a + row]), pa.array(first - at[row])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _windows_of(code: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The smallest document of all windows of each distinct fragment, and of each window of those whose windows differ in it.

    Fragments are in the order of their codes. A code's only fragment needs no sorting; of the others those that can have a window in
    common are sorted by suffix arrays of SHARD_BYTES at least, the codes of one together.
    """
    low, held = low.copy(), {}
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    size = np.diff(np.append(first, len(code)))
    several = np.repeat(size, size) > 1
    place = np.cumsum(np.add.reduceat(np.where(several, sizes, 0), first)) // SHARD_BYTES
    todo = np.flatnonzero(several)
    part_of = np.repeat(place, size)[todo]
    for part in np.split(todo, np.flatnonzero(np.diff(part_of)) + 1) if len(todo) else []:
        part = part[may_share(raw[_ranges(starts[part], sizes[part])], sizes[part], code[part], least)]
        if not len(part):
            continue
        for f, h in zip(part.tolist(), smallest_holders(raw[_ranges(starts[part], sizes[part])], sizes[part], low[part], least), strict=True):
            if (h == h[0]).all():
                low[f] = h[0]
            else:
                held[f] = h
    return low, held


def _whole(batches: Iterator[pa.RecordBatch], order: list[str]) -> pa.Table | None:
    """All rows of the partition, which holds one shard, in order."""
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in order]).combine_chunks() if parts else None


def _spans_batch(ids: np.ndarray, v: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(16)
    spans = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs.astype("<i8")))])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v), spans], names=["id", "v", "spans"])


def _shard(least: int):
    """(id, v, spans) of a partition's fragments: the removed runs of each occurrence, as packed pairs of start and end.

    Occurrences of one code are together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches, ["code", "fragment"])) is None:
            return
        code, doc, v, at = (table.column(c).to_numpy() for c in ("code", "id", "v", "at"))
        texts = table.column("fragment").chunk(0)
        raw, bounds = _bytes_of(texts)
        sizes = np.diff(bounds)
        again = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False) & (code[1:] == code[:-1])
        fresh = np.concatenate(([True], ~again))
        first, kind = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        low, held = _windows_of(code[first], raw, bounds[first], sizes[first], np.minimum.reduceat(doc, first), least)
        parted = np.zeros(len(first), dtype=bool)
        parted[list(held)] = True
        rows = np.flatnonzero(~parted[kind] & (low[kind] < doc))
        for a in range(0, len(rows), 1 << 16):
            part = rows[a : a + (1 << 16)]
            yield _spans_batch(doc[part], v[part], np.stack([at[part], at[part] + sizes[part]], axis=1))
        ids, kinds, pairs = [], [], []
        for row, f in zip(*(x.tolist() for x in (np.flatnonzero(parted[kind]), kind[parted[kind]])), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], held[f] < doc[row], [False])).view(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                ids.append(doc[row])
                kinds.append(v[row])
                pairs.append((at[row] + a, at[row] + b + least - 1))
        if ids:
            yield _spans_batch(np.array(ids), np.array(kinds), np.array(pairs))

    return run


def _settled(rows: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    packed = [h[:1].tobytes() if (h == h[0]).all() else h.tobytes() for _, h in rows]
    return pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.binary()), pa.array(packed, pa.binary())], names=["mark", "holders"])


def _holders(least: int):
    """(mark, holders) of distinct fragments: the smallest document of each window, packed; one value where all windows agree.

    Fragments none of whose windows has a smaller document than their largest one stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches, ["code"])) is None:
            return
        code, low, high = (table.column(c).to_numpy() for c in ("code", "low", "high"))
        raw, bounds = _bytes_of(table.column("fragment").chunk(0))
        low, held = _windows_of(code, raw, bounds[:-1], np.diff(bounds), low, least)
        marks = table.column("mark")
        parted = np.zeros(len(code), dtype=bool)
        parted[list(held)] = True
        rows = np.flatnonzero(~parted & (low < high))
        yield _settled([(m, low[k : k + 1]) for m, k in zip(marks.take(pa.array(rows)).to_pylist(), rows.tolist(), strict=True)])
        rows = [k for k, h in held.items() if h.min() < high[k]]
        yield _settled([(m, held[k]) for m, k in zip(marks.take(pa.array(rows, pa.int64())).to_pylist(), rows, strict=True)])

    return run


def _each_window(least: int):
    """(mark, at, window, low) of every window of distinct fragments, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, p, hashlib.blake2b(f[p : p + least], digest_size=16).digest(), x) for m, f, x in zip(*[batch.column(c).to_pylist() for c in ("mark", "fragment", "low")], strict=True) for p in range(len(f) - least + 1)]
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["mark", "at", "window", "low"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _settled([(m, np.array(h, dtype=np.int64)) for m, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])


def _spans(least: int):
    """(id, v, spans): the removed runs of each occurrence of a fragment, as packed pairs of start and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, at, windows, holders in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = np.frombuffer(holders, dtype="<i8")
                h = np.repeat(h, windows) if len(h) == 1 else h
                edge = np.flatnonzero(np.diff(np.concatenate(([False], h < i, [False])).view(np.int8)))
                if len(edge):
                    pairs = edge.reshape(-1, 2) + at
                    pairs[:, 1] += least - 1
                    out.append((i, v, pairs.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "v", "spans"])

    return run


def merge_spans(packed: list[bytes] | None) -> np.ndarray:
    """Maximal runs out of packed pairs of start and end."""
    pairs = np.frombuffer(b"".join(packed or []), dtype="<i8").reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], axis=1)


def _cut(least: int, kept_text: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                batch = big.slice(start, 1024)
                n_bytes, removed, runs, digests, texts = [], [], [], [], []
                for t, packed, copy in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), batch.column("_copy").to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    spans = np.array([[0, len(raw)]]) if copy and len(raw) >= least else merge_spans(packed)
                    kept = raw
                    if len(spans):
                        edges = [0, *spans.ravel().tolist(), len(raw)]
                        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    n_bytes.append(len(raw))
                    removed.append(len(raw) - len(kept))
                    runs.append(len(spans))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(t if not len(spans) else kept.decode("utf-8", "ignore"))
                new = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if kept_text else [])]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if kept_text else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=[*columns, *names])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, kept_text: bool = False, sample: int = 4096, often: int = 2, crowd: int = 4_096, hot: int = 1024) -> DataFrame:
    """df's rows without text, with n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept_text.

    Every byte is removed that a string of `least` bytes covers which also starts in a document with a smaller key. A null text counts as
    empty, and texts under least bytes lose nothing. Of rows with equal texts all but those with the smallest key go whole; rows
    that repeat a key don't count as smaller than each other. Rows with a null key keep their text and give nothing to others. An
    empty table gives an empty result. df's other columns stay, but for those named like the new ones. kept_text drops the rest of a
    UTF-8 character that a removed run cuts.

    Minimizers that `often` documents of a sample hold are left out of the count that finds shared ones; of the others, that count
    tells which more than `hot` documents hold. The fragments of both are aggregated before they are dealt out, so that a fragment of
    very many documents is one row; if more than `crowd` different fragments of a minimizer are left, as around a passage of very many
    documents, they are compared window by window through an aggregation. Results depend on none of the four. Other minimizers'
    occurrences meet in one task each. least under GRAM + 8 is refused.
    """
    if least < GRAM + 8:
        raise ValueError(f"least is {least}; minimizers need {GRAM + 8} bytes or more")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "suffix")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("id"), value.alias("text")).where("id is not null")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    slim = scratch.keep(docs.select("id", digest.alias("digest"), F.xxhash64("text").alias("v"), F.octet_length("text").alias("n")), "digests")
    firsts = slim.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.max("v").alias("v"), F.count("*").alias("rows"))
    total = slim.agg(F.count("*").alias("docs"), F.sum("n").alias("bytes")).first()
    if not total["docs"]:
        common = np.zeros(0, dtype=np.int64)
    else:
        part = docs.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total["docs"]))).select("text").distinct()
        found = part.mapInArrow(_codes(least), "code long").groupBy("code").count().where(F.col("count") >= often)
        common = np.sort(np.array([r["code"] for r in found.collect()], dtype=np.int64))  # bounded by the sample
    buckets = 4 * max(partitions, (total["bytes"] or 0) // 16_000_000)
    packed = docs.mapInArrow(_packed(least, buckets, common), "bucket int, codes binary, docs binary")
    shared = scratch.keep(packed.repartition(max(1, buckets // 4), "bucket").mapInArrow(_shared(hot), "id long, code long"), "shared")
    # One row holds each text: the first of equal ones.
    chosen = firsts.select(F.col("first").alias("id"), "v")
    lists = shared.groupBy("id").agg(F.collect_set("code").alias("codes"))
    listed = chosen.join(lists, "id", "left").select("id", "v", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"))
    if not len(common):
        listed = listed.where(F.size("codes") > 0)
    texts = docs.withColumn("v", F.xxhash64("text")).join(listed, ["id", "v"])
    pieces = texts.select("id", "text", "codes", "v").mapInArrow(_fragments(least, common), "hot boolean, code long, fragment binary, id long, v long, at long")
    pieces = scratch.keep(pieces, "fragments")
    scratch.drop(shared)
    shards = max(partitions, (total["bytes"] or 0) // 16_000_000)
    spans = pieces.where("not hot").drop("hot").repartition(shards, "code").mapInArrow(_shard(least), "id long, v long, spans binary")
    many = pieces.where("hot")
    if not many.isEmpty():
        distinct = many.groupBy("code", "fragment").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        distinct = scratch.keep(distinct.withColumn("mark", F.unhex(F.md5("fragment"))), "distinct")
        crowded = scratch.keep(distinct.groupBy("code").count().where(F.col("count") > crowd).select("code"), "crowded")
        held = distinct.join(crowded, "code", "left_anti").repartition(shards, "code").mapInArrow(_holders(least), "mark binary, holders binary")
        if not crowded.isEmpty():
            windows = distinct.join(crowded, "code", "left_semi").mapInArrow(_each_window(least), "mark binary, at int, window binary, low long")
            lowest = windows.groupBy("window").agg(F.min("low").alias("holder"))
            lists = windows.join(lowest, "window").groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("at", "holder"))).alias("h"))
            held = held.union(lists.select("mark", F.transform("h", lambda x: x["holder"]).alias("h")).mapInArrow(_pack, "mark binary, holders binary"))
        places = many.select("id", "v", "at", (F.length("fragment") - least + 1).cast("long").alias("windows"), F.unhex(F.md5("fragment")).alias("mark")).join(held, "mark")
        spans = spans.union(places.select("id", "v", "at", "windows", "holders").mapInArrow(_spans(least), "id long, v long, spans binary"))
    spans = scratch.keep(spans.groupBy("id", "v").agg(F.collect_list("spans").alias("_spans")), "spans")
    scratch.drop(pieces)
    copies = slim.select("id", "digest", F.col("v").alias("own")).join(firsts.where("rows > 1"), "digest").where("id > first").select("id", F.col("own").alias("v")).distinct().withColumn("_copy", F.lit(True))
    facts = spans.join(copies, ["id", "v"], "full").withColumnsRenamed({"id": "_id", "v": "_v"})
    names = {"n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if kept_text else [])}
    columns = [c for c in df.columns if c != text and c.lower() not in names]
    others = [f"c{i}" for i in range(len(columns))]  # whatever the table's columns are called
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(columns, others, strict=True)], F.col(key).cast("long").alias("_id"), value.alias("_text")).withColumn("_v", F.xxhash64("_text"))
    rows = rows.join(facts, ["_id", "_v"], "left").select(*others, "_text", "_spans", "_copy")
    new = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + ([T.StructField("kept_text", T.StringType())] if kept_text else [])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns] + new)
    return rows.mapInArrow(_cut(least, kept_text, columns), schema)

"""Exact deduplication through counting quotient filters.

Every partition counts the 64-bit fingerprints of its texts in a counting quotient filter: the high bits of a fingerprint choose a
quotient, the low ones, the remainder, stand sorted in the quotient's run beside their count. Remainders of one quotient are sorted and
quotients ascend, so filters merge like sorted lists and nothing is lost. Filters are cut into blocks of fingerprints, which merge
apart from each other. A fingerprint that counts one is a text that no other equals; texts of the others are compared byte by byte.
"""

from __future__ import annotations

import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fingerprints that a task holds before it writes a filter, and that a merging task holds beside the merged ones.
FLUSH = 1 << 20
#: Fingerprints, or groups, that may be broadcast: 32 MB at most. Beyond it keys are shuffled, frequent ones apart.
BROADCAST = 1 << 20
#: A fingerprint is frequent from so many rows on, and from so many parts of all rows: at most PARTS are.
FREQUENT, PARTS = 10_000, 10_000
#: Texts of a fingerprint with more rows than this are compared in SALTS shares first.
SHARED, SALTS = 1_000, 64


def pack(prints: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Counting quotient filter of ascending distinct fingerprints below 2 ** width: about as many quotients as fingerprints."""
    n = len(prints)
    q = min(max(int(n).bit_length(), 1), width, 30)
    quotient, size = (prints >> np.uint64(width - q)).astype(np.int64), (width - q + 7) // 8
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)
    remainder = prints & np.uint64((1 << (width - q)) - 1)
    low = np.ascontiguousarray(remainder.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :size]
    more = counts > 1
    parts = (np.packbits(occupied), np.packbits(last), low, np.packbits(more), counts[more].astype("<i8"))
    return struct.pack("<IBB", n, q, width) + b"".join(x.tobytes() for x in parts)


def unpack(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, ascending, and counts of a filter."""
    n, q, width = struct.unpack_from("<IBB", filter_)
    at, size = 6, (width - q + 7) // 8

    def bits(k: int) -> np.ndarray:
        nonlocal at
        at += (k + 7) // 8
        return np.unpackbits(np.frombuffer(filter_, np.uint8, (k + 7) // 8, at - (k + 7) // 8), count=k).astype(bool)

    occupied, last = bits(1 << q), bits(n)
    low = np.zeros((n, 8), np.uint8)
    low[:, :size] = np.frombuffer(filter_, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    more, counts = bits(n), np.ones(n, np.int64)
    counts[more] = np.frombuffer(filter_, "<i8", int(more.sum()), at)
    run = np.cumsum(last) - last
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    return (quotient << np.uint64(width - q) if width > q else quotient) | low.view("<u8").ravel(), counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending list of fingerprints out of several, counts added."""
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")  # merges ascending lists
    prints, counts = prints[order], counts[order]
    if not len(prints):
        return prints, counts
    new = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[new], np.add.reduceat(counts, new)


def _build(block_bits: int, flush: int):
    width = 64 - block_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = (prints >> np.uint64(width)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            rest = prints & np.uint64((1 << width) - 1)
            filters = [pack(rest[a:b], counts[a:b], width) for a, b in zip(starts, np.append(starts[1:], len(prints)), strict=True)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[starts], pa.int32()), "filter": pa.array(filters, pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(np.uint64))
                if sum(map(len, held)) >= flush:
                    yield from out()
        if held:
            yield from out()

    return run


def _merged(block_bits: int, flush: int):
    """Filters that arrive by block -> the block's fingerprints with a count above one."""
    width = np.uint64(64 - block_bits)

    def out(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        prints, counts = merge(parts)
        prints, counts = prints[counts > 1], counts[counts > 1]
        if block_bits:
            prints = prints | (np.uint64(block) << width)
        for at in range(0, len(prints), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({"print": pa.array(prints[cut].view(np.int64)), "n": pa.array(counts[cut].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for block, filter_ in zip(batch.column("block").to_pylist(), batch.column("filter"), strict=True):
                if block != now:
                    if parts:
                        yield from out(now, parts)
                    now, parts = block, []
                parts.append(unpack(filter_.as_buffer().to_pybytes()))
                if len(parts) > 1 and sum(len(p) for p, _ in parts[1:]) > max(flush, len(parts[0][0])):
                    parts = [merge(parts)]
        if parts:
            yield from out(now, parts)

    return run


def repeated_prints(prints: DataFrame, rows: int, flush: int = FLUSH) -> DataFrame:
    """(print, n) of the fingerprints, longs in the first column, that more than one row has; rows, their number, sets the blocks' number."""
    bits = min(max((rows >> 18).bit_length(), 6), 13)
    filters = prints.mapInArrow(_build(bits, flush), "block int, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(bits, flush), "print long, n long")


def normal_text(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64, broadcast: int = BROADCAST, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256; equal texts are those that agree byte by byte after normal_text.

    Of equal texts the row with the largest key is kept; rows that repeat this key and text count in group_size and one of them is kept.
    A null key is smaller than any other, so such a row is kept only where all of its group have none, and keep_id is null then. Null
    texts are empty ones and equal each other. Other columns of docs are not read. An empty table gives an empty one. bits: of the
    fingerprint; fewer make more texts share one, which the comparison tells apart. broadcast and frequent: the module's constants.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    named = docs.select(F.col(f"`{key}`").alias("doc_id"), normal_text(F.col(f"`{text}`")).alias("normal"))
    rows = named.withColumn("print", F.shiftleft(F.xxhash64("normal"), 64 - bits) if bits < 64 else F.xxhash64("normal"))
    slim = scratch.keep(rows.select("doc_id", "print", F.unhex(F.sha2("normal", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "rows")
    total = slim.count()
    prints = scratch.keep(repeated_prints(slim.select("print"), total), "prints")
    often = prints.where(F.col("n") > max(frequent, total // PARTS)).select("print")

    def meet(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        """left joined with right, which has few rows of each print: by broadcast if there are few, else frequent prints alone are."""
        if right.count() <= broadcast:
            return left.join(F.broadcast(right), on, how)
        alone = left.join(F.broadcast(often), "print", "left_semi").join(F.broadcast(right.join(F.broadcast(often), "print", "left_semi")), on, how)
        return alone.unionByName(left.join(F.broadcast(often), "print", "left_anti").join(right.join(F.broadcast(often), "print", "left_anti"), on, how))

    shared = meet(rows.select("print", "normal"), prints, ["print"], "inner")
    shared = shared.select("print", "normal", F.when(F.col("n") > SHARED, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1).alias("salt"))
    parts = shared.groupBy("print", "salt", "normal").agg(F.count("*").alias("n"))
    whole = parts.where("salt < 0").select("print", "normal", "n").union(parts.where("salt >= 0").groupBy("print", "normal").agg(F.sum("n").alias("n")))
    same = scratch.keep(whole.where("n > 1").select("print", F.unhex(F.sha2("normal", 256)).alias("sha"), "n"), "texts")
    best = meet(slim, prints.select("print"), ["print"], "left_semi").groupBy("print", "sha").agg(
        F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"), F.count("*").alias("size")
    )
    # A digest stands for one text only if all rows that have it were found equal.
    size = F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.lit("different texts with one SHA-256")))
    groups = scratch.keep(best.where("size > 1").join(same, ["print", "sha"]).select("print", "sha", "keep_id", "keep_row", size.alias("group_size")), "groups")
    out = meet(slim, groups, ["print", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("doc_id").alias(key), F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seekable format's footer (a skippable frame that
lists each frame's compressed and plain size), and an index maps each record identifier to its bundle, frame, and offset within
the frame, so that one record costs one frame. Equal payloads are stored once: later ones become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values of the public Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_SCHEMA = "key long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"
RECORD_SCHEMA = "key long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Lists of first copies up to so many rows (about 100 bytes each) are broadcast, longer ones joined by a shuffle.
BROADCAST_ROWS = 100_000
URN = "urn:unitforge:record:"


def mark_revisits(df: DataFrame, payload: str, key: str, min_bytes: int = 100) -> DataFrame:
    """Append payload_bytes, payload_digest (hex SHA-256 of the UTF-8 payload) and first_key to df.

    first_key is the smallest key with the same payload, where that is another row's and the payload has min_bytes at least, else
    null. A null payload counts as empty. Rows that repeat the smallest key are all first; a row with a null key is never first
    unless no copy has a key.
    """
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    df = df.withColumns({"payload_bytes": F.length(raw).cast("long"), "payload_digest": F.sha2(raw, 256)})
    slim = df.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(key).alias("first_key"), F.count("*").alias("n"))
    first = Scratch(df.sparkSession, "warc").keep(slim.where("n > 1 and first_key is not null").select("payload_digest", "first_key"), "first")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    joined = df.join(first, "payload_digest", "left")
    return joined.withColumn("first_key", F.when(F.col(key).eqNullSafe(F.col("first_key")), None).otherwise(F.col("first_key")))


def _field(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(key: int | None, uri: str | None, first: int | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if key is None else key}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_field(uri)}")
    if first is not None:
        head += [f"WARC-Refers-To: <{URN}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload, size = rest[: int(fields["Content-Length"])], int(fields["X-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(t) if x and (t := x[len(URN) + 1 : -1]) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields.get("WARC-Target-URI"), number(fields.get("WARC-Refers-To")), digest, size, payload if fields["WARC-Type"] == "response" else None


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Bundle:
    """Writes one bundle file; finish() adds the footer with the seek table."""

    def __init__(self, uri: str, level: int):
        import zstandard

        self.uri, self.compress, self.frames, self.at = uri, zstandard.ZstdCompressor(level=level).compress, [], 0
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = fs.open_output_stream(path, compression=None)

    def frame(self, plain: bytes) -> tuple[int, int, int]:
        packed = self.compress(plain)
        self.file.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.at += len(packed)
        return len(self.frames) - 1, self.at - len(packed), len(packed)

    def finish(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, read from a bundle's footer alone."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        f.seek(end - 9 - 8 * n)
        sizes = struct.iter_unpack("<II", f.read(8 * n))
        out, at = [], 0
        for packed, plain in sizes:
            out.append((at, packed, plain))
            at += packed
        return out


def write_bundles(df: DataFrame, payload: str, key: str, uri: str, out_dir: str, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Write a record for each row of mark_revisits' output into bundles under out_dir; returns the written index (INDEX_SCHEMA).

    A bundle's name is new with each attempt of a task and only the bundles that the index names count, so a repeated task leaves
    at most an unread file. A null payload is stored as an empty one, a null address without a target field; a record longer than
    frame_bytes has a frame of its own. No rows give an empty index.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, waiting, places, size, done = None, [], [], 0, []

        def flush() -> None:
            nonlocal waiting, places, size
            if waiting:
                frame, at, packed = bundle.frame(b"".join(waiting))
                done.extend((k, bundle.uri, frame, at, packed, offset, length) for k, offset, length in places)
                waiting, places, size = [], [], 0

        for pdf in batches:
            for k, u, first, digest, n, text in pdf.itertuples(index=False, name=None):
                k, first = (None if pd.isna(x) else int(x) for x in (k, first))
                if bundle is None:
                    bundle = _Bundle(f"{out_dir}/{uuid.uuid4().hex}.warc.zst", level)
                raw = _record(k, u, first, digest, n, b"" if text is None else text.encode("utf-8", "surrogatepass"), date)
                if size + len(raw) > frame_bytes:
                    flush()
                places.append((k, size, len(raw)))
                waiting.append(raw)
                size += len(raw)
                if bundle.at + size > bundle_bytes:
                    flush()
                    bundle.finish()
                    bundle = None
            if bundle is not None:
                flush()
            if done:
                out = pd.DataFrame(done, columns=["key", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"])
                yield out.assign(key=out["key"].astype("Int64"))
                done = []
        if bundle is not None:
            bundle.finish()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.col("first_key").cast("long").alias("first"), "payload_digest", "payload_bytes", F.col(payload).alias("payload"))
    return (scratch or Scratch(df.sparkSession, "warc")).keep(rows.mapInPandas(run, INDEX_SCHEMA), "index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that the index's rows name (RECORD_SCHEMA): each needed frame is read and unpacked once.

    Select rows of the index first to fetch single records. Digest and length of each stored payload are checked; a revisit has
    no payload of its own but the full one's digest and length. With payloads=False the payloads stay behind.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        uri = pdf["bundle"].iloc[0]
        table = seek_table(uri)
        fs, path = _open(uri)
        with fs.open_input_file(path) as f:
            for frame, group in pdf.groupby("frame"):
                at, packed, _ = table[frame]
                f.seek(at)
                plain = unpack(f.read(packed))
                for offset, length in zip(group["offset"].tolist(), group["length"].tolist(), strict=True):
                    row = _parse(plain[offset : offset + length])
                    rows.append(row if payloads else (*row[:-1], None))
        out = pd.DataFrame(rows, columns=["key", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"])
        return out.assign(key=out["key"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the index is small, what it names is not
    return index.repartition(tasks, "bundle").groupBy("bundle").applyInPandas(run, RECORD_SCHEMA)

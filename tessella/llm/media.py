"""Media columns: content-addressed payloads in tar shards.

Payloads are stored as lossless 8-bit greyscale PNG images, 64 samples wide, one
tar member each, named by the SHA-256 of the payload.  Rows carry digest, shard,
offset and length.  A task stores a payload once, so thousands of copies cost one
member there, without moving any payload between tasks; :func:`catalogue` then picks
one place for each digest of the whole table, and members that other tasks have
stored beside it are never read.  :func:`probe` fills metadata columns of the places
from the 33 bytes of a header by range reads; :func:`read_back` decodes the members and
computes features.  Both deal places to tasks by the bytes of their members, in the
order of the shards.  :func:`describe` does all that and gives each row what its digest has.

A payload is the text's UTF-8 (null: none) padded with zero bytes to a positive
multiple of 64.  Null and empty texts share a payload of 64 zeros.  Repeated rows
refer to the same member; a table without rows writes no shard.  Columns of the
input keep their names unless they clash with the columns named here, which win.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import RangeReader, durable, fresh_dir, open_sink

WIDTH = 64
#: A shard is closed and another begun beyond this size.
SHARD_BYTES = 1 << 30
#: Bytes of members that a reading task is dealt.
READ_BYTES = 64 << 20
#: The PNG signature and the bytes up to the end of its first chunk.
PNG_SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33

ROW_SCHEMA = "digest string, shard string, offset bigint, length bigint, n_bytes bigint"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded payload and the number of bytes before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """Greyscale PNG with 8-bit samples, rows of 64, no row filter; the same payload always gives the same bytes."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict:
    """Metadata from the first 33 bytes."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a stored image")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": 1 if colour == 0 else 3}


def decode_png(data: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` wrote; every chunk's checksum is verified."""
    head = png_header(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a stored image is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a stored image has filtered rows")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Whole-number features of the samples: size, sum, sum of squares, distinct values, ascents."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    return f"size={WIDTH}x{len(x) // WIDTH};sum={x.sum()};squares={(x * x).sum()};distinct={len(np.unique(x))};ascents={(x[1:] > x[:-1]).sum()}"


class _Shard:
    """A tar file under way: members one after another, offsets of their data."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        self.file, self.size = open_sink(self.uri), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        at = self.size + len(head)
        for part in (head, data, bytes(-len(data) % 512)):
            self.file.write(part)
            self.size += len(part)
        return at

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def store(df: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads of all rows to tar shards below `folder` (the shared folder by default).

    Returns a durable table with the id, digest, shard, offset, length (of the
    image) and n_bytes, a row for every input row.  No payload is shuffled.
    """
    folder = folder or fresh_dir(df.sparkSession, "media")

    def run(batches):
        import pandas as pd

        shard, placed = None, {}
        for batch in batches:
            rows = []
            for text in batch["text"].tolist():
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in placed:
                    if shard is None or shard.size > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = _Shard(folder)
                    image = encode_png(payload)
                    placed[digest] = shard.uri, shard.add(f"{digest}.png", image), len(image)
                rows.append((digest, *placed[digest], n))
            out = pd.DataFrame(rows, columns=["digest", "shard", "offset", "length", "n_bytes"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out
        if shard:
            shard.close()

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return durable(source.mapInPandas(run, f"id {kind}, {ROW_SCHEMA}"), "media-rows").withColumnRenamed("id", id_col)


def catalogue(rows: DataFrame) -> DataFrame:
    """One place (shard, offset, length) and the number of rows for each digest; combines before it shuffles."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("n_rows")).select("digest", "at.*", "n_rows")


def _ranges(rows: DataFrame, schema: str, size: int | None, derive) -> DataFrame:
    """Add what `derive(bytes)` returns for each row's byte range; the whole member, or its first `size` bytes."""
    names = [part.split()[0] for part in schema.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        import pandas as pd

        reader, opened = None, None
        for batch in batches:
            known, out = {}, []  # the results of one batch: copies are read once
            for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
                if (shard, offset) not in known:
                    if shard != opened:
                        if reader:
                            reader.close()
                        reader, opened = RangeReader(shard), shard
                    known[shard, offset] = derive(reader.read(int(offset), int(length if size is None else min(size, length))))
                out.append(known[shard, offset])
            yield pd.concat([batch[kept].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)
        if reader:
            reader.close()

    return rows.select(*kept).mapInPandas(run, f"{shape}, {schema}")


def probe(rows: DataFrame) -> DataFrame:
    """Add width, height, bit_depth and channels by reading headers only."""

    def derive(data: bytes) -> tuple:
        return tuple(png_header(data).values())

    return _ranges(rows, "width bigint, height bigint, bit_depth int, channels int", HEADER_BYTES, derive)


def read_back(rows: DataFrame) -> DataFrame:
    """Add what the stored members hold: digests of payload and image, sizes, last 64 bytes' crc32, features."""

    def derive(data: bytes) -> tuple:
        samples = decode_png(data)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)

    return _ranges(rows, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", None, derive)


def dealt(places: DataFrame, task_bytes: int = READ_BYTES) -> DataFrame:
    """Places in tasks of about `task_bytes` bytes of members each, in the order of shard and offset."""
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    return places.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def describe(rows: DataFrame, *, task_bytes: int = READ_BYTES) -> DataFrame:
    """Rows of :func:`store` with what their stored members hold: header metadata, digests read back, features.

    Each digest's member is probed and read once.  The join on the digest moves rows
    and features only; the optimiser splits a digest that very many rows have.
    """
    places = durable(catalogue(rows.select("digest", "shard", "offset", "length")).drop("n_rows"), "media-places")
    told = durable(read_back(probe(dealt(places, task_bytes))).drop("shard", "offset", "length"), "media-told")
    return rows.drop(*[c for c in told.columns if c != "digest"], "shard", "offset", "length").join(told, "digest")


def members(uri: str) -> list[str]:
    """Names in a shard, by the standard library's reader of tar files."""
    reader = RangeReader(uri)
    data = reader.read(0, reader.size())
    reader.close()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return tar.getnames()

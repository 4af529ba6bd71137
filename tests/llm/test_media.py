import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from tessella.llm import media
from tessella.llm.shared import local_path

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é" * 100000, "same", "same", "tail\0\0"]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "same", "c")], "doc_id long, text string, shard string")
    rows = media.store(df)
    full = media.probe(media.read_back(rows))
    got = full.collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        payload, n = media.payload_of(TEXTS[r.doc_id] if r.doc_id is not None else "same")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert r.media_sha256 == hashlib.sha256(media.encode_png(payload)).hexdigest() and r.feature == media.features(payload)
        assert (r.width, r.height, r.bit_depth, r.channels) == (64, len(payload) // 64, 8, 1)
    places = media.catalogue(rows).collect()
    assert len(places) == len({r.digest for r in got}) and sum(p.n_rows for p in places) == len(got)
    for p in places:
        assert f"{p.digest}.png" in media.members(p.shard)


def plain_png(data):
    """Samples and size by the published format, without the module."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        size = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else size
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour, _, _, lace = size
    lines = zlib.decompress(body)
    assert (depth, colour, lace, len(lines)) == (8, 0, 0, height * (width + 1))
    out, above = b"", bytes(width)
    for y in range(height):
        kind, line = lines[y * (width + 1)], lines[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        assert kind in (0, 2)
        above = line if kind == 0 else bytes((a + b) % 256 for a, b in zip(line, above, strict=True))
        out += above
    return width, height, out


def test_description_of_a_table(spark):
    """Each digest is read once, from the place that the catalogue names; rows get what an independent reader finds there."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("c").alias("digest")).repartition(6)
    rows = media.store(docs.union(docs.limit(20)))
    got = media.describe(rows, task_bytes=50_000).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) + 20
    stored = {}
    for p in media.catalogue(rows).collect():
        reader = media.RangeReader(p.shard)
        stored[p.digest] = reader.read(p.offset, p.length)
        reader.close()
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        image = stored[r.digest]
        assert plain_png(image) == (64, len(payload) // 64, payload) and (r.width, r.height) == (64, len(payload) // 64)
        counts = f"sum={sum(payload)};squares={sum(x * x for x in payload)};distinct={len(set(payload))};ascents={sum(a < b for a, b in zip(payload, payload[1:], strict=False))}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), f"size=64x{len(payload) // 64};{counts}")
    assert media.describe(media.store(docs.limit(0))).count() == 0


def test_probe_reads_headers_only(spark):
    image = media.encode_png(bytes(6400))
    assert media.png_header(image[:33])["height"] == 100
    rows = media.store(spark.createDataFrame([(1, "abc" * 1000)], "doc_id long, text string"))
    place = rows.first()
    with open(local_path(place.shard), "r+b") as file:  # bytes behind the header are damaged, and probing doesn't see them
        file.seek(place.offset + 40)
        file.write(b"\0\0\0\0")
    assert media.probe(rows).first().height == 47


def test_empty_table_and_small_shards(spark, monkeypatch):
    df = spark.createDataFrame([(i, str(i) * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert media.read_back(media.store(df.limit(0))).count() == 0
    assert media.read_back(media.store(df)).count() == 20


def test_damage_is_noticed():
    image = bytearray(media.encode_png(bytes(64)))
    image[-20] ^= 1
    import pytest

    with pytest.raises(ValueError):
        media.decode_png(bytes(image))

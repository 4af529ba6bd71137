"""Token-id files with Elias-Fano encoded document boundaries.

A file holds the ids of many documents one after another, in as few bytes an id
as the vocabulary needs, and two nondecreasing sequences in Elias-Fano code: where
each document's ids begin, and the documents' own ids.  Each value is split into
low bits, packed, and a high part in unary; a directory of every 512th one of
the unary bits lets :meth:`EliasFano.select` return a value without reading the
rest.  That is about 2 + log2(mean length) bits for a document, in place of a
table of 64-bit offsets.

Layout: ids; Elias-Fano sections of boundaries and of document ids; a JSON footer;
its length (4 bytes); magic.  Files are in ascending order of document id, and
inside a file the documents are; rows without an id come first, and rows of the
same id are in the order of a hash of their texts.  Null texts count as empty.  Empty
documents have only the end id; a table without rows has no files.
"""

from __future__ import annotations

import gc
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.shared import RangeReader, durable, fresh_dir, open_sink, worker_cache

#: Fixed value: the last bytes of a file.
MAGIC = b"TSEF1\n"
#: Ones between two entries of the select directory.
STRIDE = 512
#: Ids and documents that a reader holds at a time, at least one document; values that are packed at a time.
READ_IDS, READ_DOCS, BLOCK = 2_000_000, 1 << 16, 1 << 13
#: Bytes of text that a file holds the ids of.
FILE_BYTES = 24 << 20


class EliasFano:
    """A nondecreasing sequence of whole numbers from 0 in about 2 + log2(range / count) bits each."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, directory: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.directory = count, low_bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, dtype="<u4"))
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = b"".join(  # blocks of a multiple of 8 values, so each ends with a byte
            np.packbits(((v[i : i + BLOCK, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for i in range(0, n, BLOCK)
        )
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, width, low, np.packbits(flags, bitorder="little").tobytes(), ones[::STRIDE].astype("<u4"))

    def select(self, i: int) -> int:
        """The value at index `i`, from the directory and the bits behind its entry."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.directory[i // STRIDE]), i % STRIDE
        byte = at // 8
        word = self.high[byte] >> at % 8 << at % 8
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> first % 8
        return (one - i) << self.low_bits | chunk & (1 << self.low_bits) - 1

    def between(self, start: int, end: int) -> np.ndarray:
        """The values at indexes from `start` to before `end`: one select finds the first, the bits from there on the rest."""
        n = min(end, self.count) - start
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        first = (self.select(start) >> self.low_bits) + start  # the bit of the first value
        last = (self.select(start + n - 1) >> self.low_bits) + start + n - 1
        byte = first // 8
        flags = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8, count=last // 8 - byte + 1, offset=byte), bitorder="little")
        ones = np.flatnonzero(flags[: last - 8 * byte + 1])
        high = ones[ones >= first - 8 * byte] + 8 * byte - np.arange(start, start + n)
        at, end_bit = start * self.low_bits, (start + n) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low[at // 8 : (end_bit + 7) // 8], dtype=np.uint8), bitorder="little")[at % 8 : at % 8 + n * self.low_bits]
        low = bits.reshape(n, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high.astype(np.int64) << self.low_bits) | low

    def last_at_most(self, value: int, start: int) -> int:
        """The greatest index from `start` on whose value is `value` or less, by selects."""
        low, high = start, self.count - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.select(middle) <= value else (low, middle - 1)
        return low

    def parts(self) -> list[bytes]:
        return [self.low, self.high, self.directory.tobytes()]


class Writer:
    """Appends documents in ascending order; holds lengths and document ids, never their ids."""

    def __init__(self, uri: str, id_bytes: int):
        self.uri, self.id_bytes, self.file = uri, id_bytes, open_sink(uri)
        self.lengths: list[int] = []
        self.docs: list[int | None] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.file.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.lengths.append(len(ids))
        self.docs.append(doc)

    def close(self) -> tuple[int, int]:
        """Write sections and footer; returns the numbers of documents and ids."""
        nulls = sum(d is None for d in self.docs)
        named = np.array(self.docs[nulls:], dtype=np.int64)
        base = int(named[0]) if len(named) else 0
        ends = np.cumsum(np.array(self.lengths, dtype=np.int64))
        total = int(ends[-1]) if len(ends) else 0
        at, sections = total * self.id_bytes, []
        for code in (EliasFano.build(np.r_[0, ends]), EliasFano.build((named.astype(object) - base).astype(np.uint64) if len(named) else named)):
            sizes = [len(p) for p in code.parts()]
            sections.append({"at": at, "count": code.count, "low_bits": code.low_bits, "sizes": sizes})
            for part in code.parts():
                self.file.write(part)
            at += sum(sizes)
        foot = json.dumps({"ids": total, "id_bytes": self.id_bytes, "nulls": nulls, "base": base, "sections": sections}).encode()
        self.file.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        self.file.close()
        return len(self.docs), total


class Reader:
    """Random access by index of document; reads only the ranges it needs."""

    def __init__(self, uri: str, size: int | None = None):
        self.file = RangeReader(uri)
        size = size or self.file.size()
        tail = self.file.read(size - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        (length,) = struct.unpack("<I", tail[:4])
        self.foot = json.loads(self.file.read(size - len(tail) - length, length))
        self.bounds, self._docs = (self._code(s) for s in self.foot["sections"])

    def _code(self, section: dict) -> EliasFano:
        at, parts = section["at"], []
        for size in section["sizes"]:
            parts.append(self.file.read(at, size))
            at += size
        return EliasFano(section["count"], section["low_bits"], parts[0], parts[1], np.frombuffer(parts[2], dtype="<u4"))

    def __len__(self) -> int:
        return self.bounds.count - 1

    def doc_ids(self) -> list[int | None]:
        return self.names(0, len(self))

    def names(self, start: int, end: int) -> list[int | None]:
        """Document ids from index `start` to before `end`."""
        nulls = self.foot["nulls"]
        known = self._docs.between(max(0, start - nulls), max(0, end - nulls))
        return [None] * max(0, min(end, nulls) - start) + [int(x) + self.foot["base"] for x in known]

    def _ids(self, start: int, end: int) -> np.ndarray:
        width = self.foot["id_bytes"]
        return np.frombuffer(self.file.read(start * width, (end - start) * width), dtype=f"<u{width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, by two selects and one range read."""
        return self._ids(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the file, ids) of all documents, in blocks of `READ_IDS` ids and `READ_DOCS` documents.

        Selects find where a block ends and its documents' offsets, so no table of all offsets is made.
        """
        i, n = 0, len(self)
        while i < n:
            j = min(n, i + READ_DOCS, max(i + 1, self.bounds.last_at_most(self.bounds.select(i) + READ_IDS, i)))
            ends, names = self.bounds.between(i, j + 1), self.names(i, j)
            block = self._ids(int(ends[0]), int(ends[-1]))
            for k in range(j - i):
                yield names[k], int(ends[k]), block[ends[k] - ends[0] : ends[k + 1] - ends[0]]
            i = j

    def close(self) -> None:
        self.file.close()


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of runs one after another: `sizes` from each of `starts` on."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


class LibraryEncoder(bpe.TrieBpe):
    """The same cut of texts into recurring pieces; the tokenizers library encodes the distinct ones.

    Arrow cuts many texts at once and finds their distinct pieces, so only those
    are looked up and encoded; the ids of all pieces are then gathered by number.
    Its memory comes from the C library, which gives it back at once.
    """

    most_known, cut_chars = 1_500_000, 2_000_000

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # it gets no word twice
        self.opens = np.array([b[:1] == b" " for b in self.bytes_of])  # tokens that begin with a space

    def encode_packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The packed ids of each text, in order; memory is bounded by `cut_chars` and the longest text."""
        plain, counts, rests, chars = [], [], [], 0
        for text in texts:
            text, rest = text or "", None
            if (words := self._uncut(text)) is None:
                first, space, rest = text.partition(" ")
                words, rest = [first], rest if space else None
            plain += words
            counts.append(len(words))
            rests.append(rest)
            chars += len(text)
            if chars >= self.cut_chars:
                yield from self._gather(plain, counts, rests)
                plain, counts, rests, chars = [], [], [], 0
        yield from self._gather(plain, counts, rests)

    def _gather(self, plain: list[str], counts: list[int], rests: list[str | None]) -> Iterator[bytes]:
        """The packed ids of texts, each of which is `counts` of the `plain` pieces and the pieces of its rest, each behind a space."""
        if not counts:
            return
        pool = pa.system_memory_pool()
        behind = pc.split_pattern(pa.array(rests, pa.large_string(), memory_pool=pool), " ", memory_pool=pool)
        n_plain, n_behind = np.array(counts, dtype=np.int64), pc.fill_null(pc.list_value_length(behind), 0).to_numpy().astype(np.int64)
        first, ids_a, sizes_a = self._numbered(self._plain, "", pa.array(plain, pa.large_string(), memory_pool=pool))
        other, ids_b, sizes_b = self._numbered(self._after, " ", behind.flatten())
        ids, sizes = np.concatenate([ids_a, ids_b]), np.concatenate([sizes_a, sizes_b])
        ends = np.cumsum(n_plain + n_behind)
        at = _runs(ends - n_plain - n_behind, n_plain)
        of, rest = np.empty(int(ends[-1]), dtype=np.int64), np.ones(int(ends[-1]), dtype=bool)
        rest[at] = False
        of[at], of[rest] = first, other + len(sizes_a)
        long = sizes[of]
        found = ids[_runs((np.cumsum(sizes) - sizes)[of], long)]
        stops = np.r_[0, np.cumsum(long)][ends].tolist()  # each text has a piece
        for a, b in zip([0, *stops], stops, strict=False):
            yield found[a:b].tobytes()

    def _numbered(self, table: dict[str, bytes], space: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's number among the distinct ones, the ids of those one after another, and how many each has."""
        coded = pc.dictionary_encode(pieces, memory_pool=pa.system_memory_pool())
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(table.get, names))
        if new := [name for name, known in zip(names, packed, strict=True) if known is None]:
            if len(self._after) + len(self._plain) + len(new) > self.most_known:
                self._forget(self.most_known // 4)
            fresh = iter(self._learnt(table, space, new))
            packed = [next(fresh) if known is None else known for known in packed]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        return coded.indices.to_numpy(), np.frombuffer(b"".join(packed), dtype="<u4"), sizes

    def _learnt(self, table: dict[str, bytes], space: str, names: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces that the table lacks, which it is told.

        Those that are no runs of parts come first, so the parts of others find them.
        """
        was_on = gc.isenabled()
        gc.disable()  # many lists and no cycles
        try:
            split, whole, marked = {}, [], []
            for name in names:
                if name[-1:] not in bpe.MARKS and "\n" not in name:
                    whole.append(name)
                elif space and len(name) > 1 and "\n" not in name and name[-2].isalpha():
                    marked.append(name)
                elif len(parts := self._parts(space + name)) > 1:
                    split[name] = parts
                else:
                    whole.append(name)
            found = self._told(table, space, whole)
            if marked:
                stems = [name[:-1] for name in marked]
                new = self._told(table, space, list(set(stems).difference(table)))
                marks = {mark: self._recall(mark) or self._told(self._plain, "", [mark])[mark] for mark in {name[-1] for name in marked}}
                found |= {name: (table.get(stem) or new[stem]) + marks[name[-1]] for name, stem in zip(marked, stems, strict=True)}
            coded = {part: self._recall(part) for part in set().union(*split.values())}
            if fresh := [part for part, known in coded.items() if known is None]:
                for part, packed in self.encode_new(fresh).items():
                    coded[part] = packed
                    self._remember(part, packed)
            found |= {name: b"".join(map(coded.__getitem__, parts)) for name, parts in split.items()}
            table.update((name, found[name]) for name in [*marked, *split] if len(name) <= bpe.CACHE_WORD_CHARS)
            return list(map(found.__getitem__, names))
        finally:
            if was_on:
                gc.enable()

    def _told(self, table: dict[str, bytes], space: str, names: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces, encoded as they are; the table is told all but long ones."""
        named = [space + name for name in names] if space else names
        found = dict(zip(names, map(self.encode_new(named).__getitem__, named), strict=True))
        table.update(found)
        for name in names:
            if len(name) > bpe.CACHE_WORD_CHARS:
                del table[name]
        return found

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces or parts of them.

        Those whose only space is their first character, and that end in no white space,
        go to the library many at a time, as one text.  As many tokens of it begin with a
        space as there are pieces, so these tokens tell the pieces apart again; else
        the group is encoded piece by piece.
        """
        joint, single = [], []
        for piece in parts:
            (joint if len(piece) > 1 and piece.rfind(" ") == 0 and not piece[1].isspace() and not piece[-1].isspace() and len(piece) < 200 else single).append(piece)
        found: dict[str, bytes] = {}
        for i in range(0, len(joint), 20_000):
            groups = [joint[j : j + 200] for j in range(i, min(i + 20_000, len(joint)), 200)]
            for group, code in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
                ids = np.array(code.ids, dtype="<u4")
                cut = np.flatnonzero(self.opens[ids])
                if len(cut) != len(group):
                    single += group
                    continue
                packed, cut = ids.tobytes(), [*(cut * 4).tolist(), 4 * len(ids)]
                for piece, a, b in zip(group, cut, cut[1:], strict=False):
                    found[piece] = packed[a:b]
        for i in range(0, len(single), 20_000):
            part = single[i : i + 20_000]
            for piece, code in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[piece] = struct.pack(f"<{len(ids := code.ids)}I", *ids)
        return found


def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of a vocabulary file, read once per worker."""
    kept = worker_cache("token files")
    if path not in kept:
        bpe.calm_collector()
        kept[path] = LibraryEncoder(path)
    return kept[path]


def write(docs: DataFrame, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES, encoder: Callable = library_encoder) -> DataFrame:
    """Encode all texts and write them, in ascending order of id, to token files of the ids of about `file_bytes` bytes of text.

    One shuffle ranges the texts by id, and rows of one id by a hash of their text;
    each task encodes and writes one file.
    Returns a durable table with a row a file: uri, first_id, first_hash, n_docs, n_ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-total // file_bytes))

    def run(batches):
        import pandas as pd

        tool, writer, first, mark = encoder(vocabulary), None, None, 0
        width = 2 if max(len(tool.bytes_of) - 1, end_id) < 1 << 16 else 4
        for batch in batches:
            names = [None if missing else int(x) for x, missing in zip(batch["id"], batch["id"].isna(), strict=True)]
            for name, packed in zip(names, tool.encode_packed(batch["text"].tolist()), strict=True):
                if writer is None:
                    writer, first, mark = Writer(f"{folder}/part-{uuid.uuid4().hex}.tokens", width), name, int(batch["h"].iloc[0])
                writer.add(name, np.append(np.frombuffer(packed, dtype="<u4"), np.uint32(end_id)))
        if writer:
            n_docs, n_ids = writer.close()
            yield pd.DataFrame({"uri": [writer.uri], "first_id": pd.array([first], dtype="Int64"), "first_hash": [mark], "n_docs": [n_docs], "n_ids": [n_ids]})

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    keyed = source.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = F.col("id").asc_nulls_first(), F.col("h")
    ranged = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    return durable(ranged.mapInPandas(run, "uri string, first_id bigint, first_hash bigint, n_docs bigint, n_ids bigint"), "token-files")


def read(manifest: DataFrame, *, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Read all files of a manifest back: id, start (ids of all documents before), n_tokens, ids_crc32, and token_ids if asked for.

    The manifest, a row a file, comes to the driver to add up where each file starts.
    """
    spark = manifest.sparkSession
    rows = manifest.orderBy(F.col("first_id").asc_nulls_first(), "first_hash").collect()  # a row a file
    starts, total = [], 0
    for r in rows:
        starts.append((r.uri, total))
        total += r.n_ids
    plan = spark.sparkContext.broadcast(starts)

    def run(batches):
        import pandas as pd

        names = ["id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * keep_ids

        def frame(held):
            return pd.DataFrame(held, columns=names).astype({"id": "Int64"})

        for batch in batches:
            for k in batch["k"].tolist():
                uri, start = plan.value[k]
                reader, held = Reader(uri), []
                for name, at, ids in reader.documents():
                    raw = ids.tobytes()
                    held.append((name, start + at, len(ids), zlib.crc32(raw), *[raw] * keep_ids))
                    if len(held) >= 5000:
                        yield frame(held)
                        held = []
                reader.close()
                if held:
                    yield frame(held)

    more = ", token_ids binary" if keep_ids else ""
    shape = f"id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{more}"
    return spark.range(0, len(rows), 1, max(1, len(rows))).withColumnRenamed("id", "k").mapInPandas(run, shape).withColumnRenamed("id", id_col)

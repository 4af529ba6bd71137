"""Toxicity by compression distance.

Two zstandard dictionaries are trained on whole texts of a bounded labelled sample,
one on ordinary and one on toxic texts.  A text is cut, at word ends, into windows of
about `WINDOW` bytes.  Each window is compressed twice: after the ordinary dictionary,
and after the toxic dictionary followed by the ordinary one.  The second can only be
shorter where the window resembles toxic text more than ordinary text, so ordinary
words cost the same either way.  Both are loaded as trained dictionaries, with the
entropy tables of the ordinary one, and the optimal parser makes lengths comparable.

A window can only be shorter after both if the toxic part has a longer match for some
place of it than the ordinary part, which is nearer and so cheaper.  It then holds one
of the *telling strings*: those that begin in the toxic part, aren't in the ordinary one,
and would be without their last byte (or have the `SHORTEST` bytes that a match needs).
Windows without any gain 0 and aren't compressed; in calibration it is the same.
zstandard bounds its search, so this is a definition and no proof: of 4138 such windows
of `check_s` compressed both ways, none differed in length.

The dictionaries are trained on the whole sample.  Two thresholds are calibrated on
the same texts, each compressed with dictionaries of the `PARTS` - 1 parts of the
sample that it isn't in: how many bytes a window must gain to count, and what share of
counting windows goes with which probability of the label toxic (an isotonic
regression, in which a text counts for all those that the sample drew it from).

Null and empty texts are one empty window.  Repeated rows get equal scores, extra
columns are ignored.  Where either class has too few labelled texts for zstandard to
train on, every score is the share of toxic documents among the labelled (0 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bounded_sample, made_apart, worker_cache

#: Bytes of a window; it ends at the last word end before.
WINDOW = 64
#: Gains in bytes among which the threshold is calibrated.
GAINS = (1, 2, 3, 4, 5, 6, 8)
#: A share of windows is counted out of so many more.
SHRINK = 30
#: Parts of the sample, told apart by a checksum of the text.
PARTS = 4
#: Bytes of the dictionaries, at most one part of so many of their text; and bytes of a training sample.
TOXIC_BYTES, ORDINARY_BYTES, PART_OF_TEXT, SAMPLE = 4096, 112_640, 8, 400
#: The compression level of the optimal parser, and bytes of its shortest match in a dictionary.
LEVEL, SHORTEST = 16, 5
#: Bytes of text that is searched at a time, and that is cut into windows at a time.
SEARCHED, CUT = 1 << 18, 1 << 22
#: Bits of a table's index, and the factor of its hash.
TABLE_BITS, FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, words preceded by one space each."""
    return b" ".join([b"", *(text or "").encode("utf-8", "replace").lower().split()])


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Cut at spaces into windows of up to `size` bytes; words longer than that are cut anywhere."""
    out, i, n = [], 0, len(data)
    while i < n:
        j = i + size
        if j < n:
            k = data.rfind(b" ", i + 1, j)
            j = k if k > i else j
        out.append(data[i:j])
        i = j
    return out or [b""]


def _loaded(book: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    told = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_FULLDICT)
    told.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=told, compression_params=params)


def header_size(book: bytes) -> int:
    """Bytes of a trained dictionary before its content: the shortest prefix that loads has 8 bytes of content."""

    def loads(n: int) -> bool:
        try:
            _loaded(book[:n])
        except zstandard.ZstdError:
            return False
        return True

    low, high = 8, len(book)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if loads(middle) else (middle + 1, high)
    return low - 8


def telling(toxic: bytes, ordinary: bytes) -> list[bytes]:
    """The telling strings up to `WINDOW` bytes; they may run on from the toxic part into the ordinary one, which follows it."""
    whole, found = toxic + ordinary[: WINDOW - 1], set()
    for at in range(len(toxic)):
        for end in range(at + SHORTEST, min(at + WINDOW, len(whole)) + 1):
            if whole[at:end] not in ordinary:
                found.add(whole[at:end])
                break
    return sorted(found)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * FACTOR) >> np.uint64(64 - TABLE_BITS)


@dataclass
class Model:
    """Dictionaries and thresholds; small, so it travels with the tasks."""

    ordinary: bytes = b""
    both: bytes = b""  # the toxic content before the ordinary one
    gain: int = 0
    shares: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(1))
    told: list[bytes] = field(default_factory=list)  # the telling strings

    def __post_init__(self):
        self._pair = self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None, "_tables": None}

    def _load(self) -> None:
        self._pair = _loaded(self.ordinary).compress, _loaded(self.both).compress
        number = partial(int.from_bytes, byteorder="little")
        long: dict[int, tuple[bytes, ...]] = {}  # by the first 8 bytes
        for x in self.told:
            if len(x) > 8:
                long[number(x[:8])] = (*long.get(number(x[:8]), ()), x)
        sizes = {n: np.array([number(x) for x in self.told if len(x) == n], dtype=np.uint64) for n in range(SHORTEST, 9)}
        tables = [np.zeros(1 << TABLE_BITS, dtype=bool) for _ in range(2)]  # by hash of the first bytes, and of all up to 8
        tables[0][_slot(np.array([number(x[:SHORTEST]) for x in self.told], dtype=np.uint64))] = True
        tables[1][_slot(np.array([number(x[:8]) for x in self.told], dtype=np.uint64))] = True
        self._tables = *tables, sizes, np.array(sorted(long), dtype=np.uint64), long

    def _places(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where telling strings begin and end, in no order."""
        first, whole, sizes, heads, long = self._tables
        mask = lambda size: np.uint64((1 << 8 * size) - 1)
        starts, ends = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
        for at in range(0, len(data), SEARCHED):
            part, n = data[at : at + SEARCHED + 8] + bytes(16), min(SEARCHED, len(data) - at)
            codes = np.empty(n, dtype=np.uint64)  # the 8 bytes from each place on
            for i in range(min(8, n)):
                codes[i::8] = np.frombuffer(part, dtype="<u8", count=(n - i + 7) // 8, offset=i)
            hits = np.flatnonzero(first[_slot(codes & mask(SHORTEST))])
            near = codes[hits]

            def among(codes: np.ndarray, told: np.ndarray) -> np.ndarray:
                likely = np.flatnonzero(whole[_slot(codes)])
                return likely[np.isin(codes[likely], told)]

            for size, told in sizes.items():
                sure = hits[among(near & mask(size), told)] + at
                starts.append(sure)
                ends.append(sure + size)
            sure = among(near, heads)
            found = [(i, i + len(x)) for i, head in zip((hits[sure] + at).tolist(), near[sure].tolist(), strict=True) for x in long[head] if data.startswith(x, i)]
            starts.append(np.array([a for a, _ in found], dtype=int))
            ends.append(np.array([b for _, b in found], dtype=int))
        return np.concatenate(starts), np.concatenate(ends)

    def _gains(self, cut: list[list[bytes]]) -> Iterator[np.ndarray]:
        held = [w for ws in cut for w in ws]
        bounds = np.cumsum([0, *map(len, held)])
        starts, ends = self._places(b"".join(held))
        where = np.searchsorted(bounds, starts, side="right") - 1
        told = np.unique(where[ends <= bounds[where + 1]]).tolist()
        sizes = []
        for compress in self._pair:  # one after the other, as both dictionaries' tables don't fit a core's cache
            known = dict.fromkeys(map(held.__getitem__, told))
            for w in known:
                known[w] = len(compress(w))
            sizes.append(np.array([known[held[i]] for i in told], dtype=int))
        gains = np.zeros(len(held), dtype=int)
        gains[told] = sizes[0] - sizes[1]
        at = 0
        for ws in cut:
            yield gains[at : at + len(ws)]
            at += len(ws)

    def gains(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Bytes by which the toxic dictionary shortens each window of each whole text; memory is bounded by `CUT` and the longest text."""
        if self._pair is None:
            self._load()
        cut, size = [], 0
        for text in texts:
            cut.append(windows(data := normal(text)))
            size += len(data)
            if size >= CUT:
                yield from self._gains(cut)
                cut, size = [], 0
        if cut:
            yield from self._gains(cut)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.both:
            return np.full(len(texts), float(self.chances[0]))
        return np.interp([share(g, self.gain) for g in self.gains(texts)], self.shares, self.chances)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def share(gains: np.ndarray, least: int) -> float:
    """Share of windows that gain at least so much."""
    return float((gains >= least).sum()) / (len(gains) + SHRINK)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The nondecreasing step function of x nearest to y: knots, values, and the weighted mean square it is off."""
    at, where = np.unique(x, return_inverse=True)
    total = np.bincount(where, weight)
    blocks: list[list[float]] = []  # first x, last x, weight, weighted sum
    for v, w, s in zip(at, total, np.bincount(where, weight * y), strict=True):
        blocks.append([v, v, w, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, w2, s2 = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + w2, blocks[-1][3] + s2
    knots = np.array([k for b in blocks for k in b[:2]])
    values = np.array([v for b in blocks for v in [b[3] / b[2]] * 2])
    off = np.average((np.interp(x, knots, values) - y) ** 2, weights=weight)
    return knots, values, float(off)


def _trained(texts: list[bytes], most: int, segment: int) -> bytes | None:
    """A dictionary of whole texts, or None where zstandard has too little to train on."""
    pieces = [w for t in texts for w in windows(t, SAMPLE)]
    try:
        return zstandard.train_dictionary(max(256, min(most, sum(map(len, pieces)) // PART_OF_TEXT)), pieces, d=6, k=segment).as_bytes()
    except zstandard.ZstdError:
        return None


def _books(ordinary: list[bytes], toxic: list[bytes]) -> Model | None:
    """A model without thresholds, or None where one class has too little text."""
    plain, marked = _trained(ordinary, ORDINARY_BYTES, 32), _trained(toxic, TOXIC_BYTES, 12)
    if plain is None or marked is None:
        return None
    cut, content = header_size(plain), marked[header_size(marked) :]
    return Model(plain, plain[:cut] + content + plain[cut:], told=telling(content, plain[cut:]))


def train(rows: list[tuple[str | None, int]], counts: dict[int, int] | None = None) -> Model:
    """Fit dictionaries on the distinct texts of each class; calibrate on the same texts, part by part.

    `counts` has the labelled rows of each class that the rows stand for.
    """
    by = {k: sorted({t or "" for t, y in rows if y == k}) for k in (0, 1)}
    counts = counts or {k: sum(y == k for _, y in rows) for k in (0, 1)}
    rate = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    texts = [(zlib.crc32(t.encode("utf-8", "replace")) % PARTS, k, t) for k in (0, 1) for t in by[k]]

    def without(part: int | None) -> Model | None:
        return _books(*([normal(t) for p, y, t in texts if y == k and p != part] for k in (0, 1)))

    model, others = without(None), [without(part) for part in range(PARTS)]
    if model is None or any(m is None for m in others):
        return Model(chances=np.array([rate]))
    by_part = [others[part].gains([t for p, _, t in texts if p == part]) for part in range(PARTS)]
    held = [(next(by_part[part]), k) for part, k, _ in texts]
    y = np.array([k for _, k in held], dtype=float)
    weight = np.array([counts[k] / len(by[k]) for _, k in held])
    tried = [(isotonic(np.array([share(g, least) for g, _ in held]), y, weight), least) for least in GAINS]
    (model.shares, model.chances, _), model.gain = min(tried, key=lambda t: t[0][2])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: Column | None = None, sample_toxic: int = 3000, sample_ordinary: int = 6000, sample_bytes: int = 24_000_000) -> Model:
    """Train on a sample of labelled documents.

    `sample_toxic` and `sample_ordinary` bound the labels that are looked up and the
    rows of the sample, `sample_bytes` the bytes of each class's whole texts.  A task of
    its own trains on the sample.
    `learn_from` is a condition on the id column; a document with several labels
    counts as toxic if any says so.
    """
    tags = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn_from is not None:
        tags = tags.filter(learn_from)
    tags = tags.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("kind")).withColumn("text", F.lit(None).cast("string"))
    most = {0: sample_ordinary, 1: sample_toxic}
    counts, drawn = bounded_sample(tags, most, 0, "toxicity labels")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = text.join(F.broadcast(drawn.select("id", "kind")), "id")  # at most sample_toxic + sample_ordinary rows are broadcast
    _, sample = bounded_sample(found.select("id", "kind", "text"), most, sample_bytes, "toxicity sample")
    return made_apart(sample.select("text", "kind"), partial(_from_sample, counts=counts))


def _from_sample(rows: list[tuple], counts: dict[int, int]) -> Model:
    return train(rows, counts)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the toxicity of the whole text, from 0 to 1.

    A column of the name `out_col` is replaced.
    """
    book = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts):
        import pandas as pd

        worker_cache("toxicity")
        return pd.Series(book.value.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(out_col, toxicity(F.col(text_col)))

"""Exact near-duplicate join on word n-grams with token-combination prefixes.

A document's set are its distinct word n-grams ("tokens" here).  Two documents
link when 100 * |x & y| >= T * |x | y|.  All tokens have one order: rare ones first,
by hash, then frequent ones, by hash.

* A set of n tokens shares at least o = ceil(T * n / 100) tokens with any set it
  links to, so two linked sets share a token among their first n - o + 1.  If that
  token is rare, the index on single rare tokens of this prefix finds the pair.
* Otherwise they share frequent tokens only.  The frequent tokens of a set are
  indexed as combinations of two neighbours in the order, over a prefix that is
  extended so far that it holds l shared tokens, where l - 1 exceeds the number of
  tokens that only one of the sets has: s <= (n_x + n_y) * (100 - T) / (100 + T).  So some two shared
  tokens are neighbours in both sets, and the pair is found by their combination.

All tokens of all documents are counted, copies within a chunk of documents once;
which count as frequent affects the work only, never the result.  Equal sets are one node of the graph, found by
a digest.  Sets that share a signature meet at the group's smallest set, its hub, and
hubs with common members are merged; a hub's sets are verified together, each against those it isn't connected with yet,
so a group of many copies costs a comparison for each copy and not for each pair.
The sets of a hub with more than `block` members are dealt out in blocks: every two
blocks meet in a task of their own, so no task holds more than two blocks.

Tokens are 64-bit hashes, and a link is verified on 128 bits of each: the second 64
come from other hashes of the words, so a false common token has a probability of
about |x| |y| / 2**128.  `n_shingles` counts distinct 64-bit hashes.

Null and empty texts have an empty set, link with nothing and are their own
component.  Repeated rows are copies of each other.  Rows without an id join in, but
never name a component unless all its rows lack one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import components
from tessella.llm.shared import durable, give_back, let_go, worker_cache

#: Bytes of text that are hashed at a time, at least one text.
CHUNK_BYTES = 2_000_000
#: A token in so many documents counts as frequent, if it is among the `FREQUENT_MOST` most frequent.
FREQUENT_FROM, FREQUENT_MOST = 6, 1 << 20
#: The share of a set, one part of so many, by which its prefix is longer than it need be.
SPARE = 20
#: Fewest partitions of the index.
PARTS_LEAST = 32
#: Every token is counted once, in one of so many parts at least; bytes of text for which there is a part; tokens and texts that a task holds at a time.
ONCE_IN, PART_BYTES, HELD_TOKENS, HELD_TEXTS = 128, 16_000_000, 1_000_000, 1000
#: Index entries of one partition; bits of the sketch of sets that met another: so many a set, within these bounds (64 MB at most).
PART_ENTRIES, SKETCH_OF_SET, SKETCH_LEAST, SKETCH_MOST = 1_000_000, 32, 1 << 22, 1 << 29
#: Parts that the rows of a hub are dealt to in joins.
SALTS = 4

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_BASE2 = _U(0xD6E8FEB86659FD93)
_BACK2 = _U(pow(int(_BASE2), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_LOWER[65:91] += _U(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a published finaliser of 64-bit hashes)."""
    x = x ^ x >> _U(33)
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ x >> _U(33)


def _powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache("set join")
    if len(kept.get(f"up{second}", ())) < n:
        for name, base in (("up", _BASE2 if second else _BASE), ("down", _BACK2 if second else _BACK)):
            factors = np.full(n, base, dtype=_U)
            factors[0] = _U(1)
            kept[f"{name}{second}"] = np.multiply.accumulate(factors)
    return kept[f"up{second}"], kept[f"down{second}"]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_sets(texts: list[str | None], width: int = 5, wide: bool = False) -> list:
    """Sorted distinct 64-bit tokens of every whole text: its `width`-word n-grams, A-Z lower-cased, words parted by ASCII white space.

    If `wide`, pairs of the tokens and, in their order, 64 bits of other hashes.
    """
    out: list = []
    factors = _mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    for a, b in _chunks(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        space = _SPACE[data]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1

        def hashed(second: bool, data=data, starts=starts, ends=ends) -> tuple[np.ndarray, np.ndarray]:
            up, down = _powers(len(data), second)
            total = np.cumsum(_LOWER[data] * down[: len(data)], dtype=_U)
            word = _mix((total[ends - 1] - total[starts - 1]) * up[starts] + (_BASE2 if second else _U(0)))
            n = max(0, len(word) - width + 1)
            gram = np.zeros(n, dtype=_U)
            for k in range(width):
                gram += word[k : k + n] * factors[k]
            return word, _mix(gram)

        word, gram = hashed(False)
        word2, gram2 = hashed(True) if wide else (word, gram)
        borders = np.searchsorted(starts, np.cumsum([1, *[len(r) + 1 for r in raw]]))
        few = lambda w: _mix(np.array([(w * factors[: len(w)]).sum(dtype=_U) + _U(len(w))], dtype=_U))
        for first, last in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if last - first >= width:
                if wide:
                    own, at = np.unique(gram[first : last - width + 1], return_index=True)
                    out.append((own, gram2[first : last - width + 1][at]))
                else:
                    out.append(np.unique(gram[first : last - width + 1]))
            elif last > first:
                out.append((few(word[first:last]), few(word2[first:last])) if wide else few(word[first:last]))
            else:
                none = np.zeros(0, dtype=_U)
                out.append((none, none) if wide else none)
    return out


def _few(texts: list[str | None], width: int, wide: bool = False) -> Iterator:
    """As :func:`token_sets`, the sets of `HELD_TEXTS` texts at a time."""
    for i in range(0, len(texts), HELD_TEXTS):
        yield from token_sets(texts[i : i + HELD_TEXTS], width, wide)


def _rest() -> None:
    """At the end of a task: a worker may be idle for long, so it keeps no powers."""
    worker_cache("set join").clear()
    give_back()


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def need(n: int, percent: int) -> int:
    """Fewest tokens that a set of n shares with a set it links to."""
    return -(-percent * n // 100)


def linked(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Index entries of one set, single rare tokens and combinations of two frequent ones; and how many it must have in common.

    The prefix of single tokens is longer than it need be by a twentieth of the set:
    a set of n shares at least l = n // 20 + 1 of them with one that it links to, or
    that one's l if it is smaller.  So a set with fewer entries in common with all
    others together links to none, unless its prefix has frequent tokens.
    """
    n = len(tokens)
    least = need(n, percent)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        often = frequent[at] == tokens
        rare, common = tokens[~often], tokens[often]
    else:
        rare, common = tokens, tokens[:0]
    prefix = n - least + 1 + n // SPARE
    singles = rare[:prefix]
    asked = least // SPARE + 1 if prefix <= len(rare) else 1
    if n - least + 1 <= len(rare) or len(common) < 2:
        return singles, asked
    # n_y <= 100 n_x / percent, so both sets together have at most this many tokens of their own
    apart = n * (100 - percent) // percent
    run = common[: max(0, len(common) - least) + apart + 2]
    return np.concatenate([singles, _mix(run[:-1] * _U(0xC2B2AE3D27D4EB4F) + run[1:])]), asked


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray((tokens >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(self.root(i), self.root(j))] = min(self.root(i), self.root(j))


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Tokens in common, on all their bits."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    return int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())


def verify(keys: list[bytes], wide: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[bytes, bytes]]:
    """Edges that connect the sets as their links do; every two sets are compared unless connected already or too unlike in size."""
    order = sorted(range(len(wide)), key=lambda i: (len(wide[i][0]), keys[i]))
    wide, keys = [wide[i] for i in order], [keys[i] for i in order]
    sets = [w[0] for w in wide]
    sizes = np.array([len(s) for s in sets])
    union = _Union(len(sets))
    edges: list[tuple[bytes, bytes]] = []
    postings = None

    def link(i: int, j: int) -> bool:
        """On all bits, once 64 bits say that the sets may link."""
        if linked(int(sizes[i]), int(sizes[j]), _shared(wide[i], wide[j]), percent):
            union.join(i, j)
            edges.append((keys[i], keys[j]))
            return True
        return False

    def meet(i: int, j: int) -> bool:
        return linked(int(sizes[i]), int(sizes[j]), _common(sets[i], sets[j]), percent) and link(i, j)

    heads: list[int] = []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(sizes, need(int(sizes[i]), percent)))
        heads = [h for h in dict.fromkeys(union.root(j) for j in ([*heads, i - 1]))]
        for h in heads[:8]:  # one of each component first: for copies that is all
            if h >= first and union.root(h) != union.root(i):
                meet(h, i)
        roots = [union.root(j) for j in range(first, i)]
        own = union.root(i)
        others = [j for j, r in zip(range(first, i), roots, strict=True) if r != own]
        if len(others) <= 16:
            for j in others:
                if union.root(j) != union.root(i):
                    meet(i, j)
            continue
        if postings is None:
            joined = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            by = np.argsort(joined, kind="stable")
            tokens, begin = np.unique(joined[by], return_index=True)
            postings = tokens, np.r_[begin, len(joined)], owner[by]
        tokens, begin, owner = postings
        at = np.searchsorted(tokens, sets[i])
        lengths = begin[at + 1] - begin[at]
        where = np.repeat(begin[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[where], minlength=len(sets))
        for j in others:
            if shared[j] and linked(int(sizes[i]), int(sizes[j]), int(shared[j]), percent) and union.root(j) != union.root(i):
                link(i, j)
    return edges


def _hubs(sig: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hub, member, entries in common) of the groups of equal signatures, each hub among its members.

    A group is parted where sizes differ too much to link.
    """
    order = np.lexsort((doc, n[doc], sig))
    sig, doc = sig[order], doc[order]
    again = np.r_[False, (sig[1:] == sig[:-1]) & (doc[1:] == doc[:-1])]
    sig, doc = sig[~again], doc[~again]
    size = n[doc]
    begins = np.r_[True, (sig[1:] != sig[:-1]) | (size[:-1] * 100 < size[1:] * percent)] if len(sig) else np.zeros(0, bool)
    hub = doc[np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))]
    alone = begins & np.r_[begins[1:], True]
    pairs, count = np.unique(np.stack([hub[~alone], doc[~alone]], axis=1), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], count


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row for each document (id, mark, n, key), and rows (token, c) of all tokens that `FREQUENT_FROM` or more documents have.

    `mark` is a hash of the text, which tells rows of one id apart.  Equal sets of a chunk
    of documents count once.  Each chunk deals its tokens out to parts by their value, and a
    task counts one part at a time, so memory is bounded by a chunk and a part.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shown = kind if kind == "binary" else "string"  # pandas would turn numbers beside nulls to doubles
    source = docs.select(F.col(id_col).cast(shown).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    parts, least = max(ONCE_IN, -(-size // PART_BYTES)), FREQUENT_FROM

    def run(batches):
        import pandas as pd

        def dealt(held: dict[bytes, np.ndarray]):
            token = np.concatenate([*held.values(), np.zeros(0, _U)])
            part = (token % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            token, cuts = token[order], np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            filled = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            return pd.DataFrame({"part": filled, "id": None, "mark": 0, "n": -1, "key": None, "tokens": [token[cuts[p] : cuts[p + 1]].tobytes() for p in filled]})

        held, size = {}, 0
        for batch in batches:
            for i in range(0, len(batch), HELD_TEXTS):
                rows = batch[i : i + HELD_TEXTS]
                sets = token_sets(rows["text"].tolist(), width)
                keys = [digest(s) if len(s) else None for s in sets]
                yield pd.DataFrame({"part": rows["mark"] % parts, "id": rows["id"], "mark": rows["mark"], "n": [len(s) for s in sets], "key": keys, "tokens": None})
                for key, s in zip(keys, sets, strict=True):
                    if key is not None and key not in held:
                        held[key] = s
                        size += len(s)
                if size >= HELD_TOKENS:
                    yield dealt(held)
                    held, size = {}, 0
        yield dealt(held)
        del held
        _rest()

    def count(batches):
        import pandas as pd

        empty = lambda n: pd.array([None] * n, dtype="Int64")

        def counted(held: list[bytes]):
            token, c = np.unique(np.frombuffer(b"".join(held), dtype=_U), return_counts=True)
            token, c = token[c >= least].view(np.int64), c[c >= least]
            return pd.DataFrame({"id": None, "mark": empty(len(c)), "n": empty(len(c)), "key": None, "token": token, "c": c})

        now, held = None, []
        for batch in batches:
            rows, dealt = batch[batch["n"] >= 0], batch[batch["n"] < 0]
            yield rows[["id", "mark", "n", "key"]].assign(token=empty(len(rows)), c=empty(len(rows)))
            for part, tokens in zip(dealt["part"].tolist(), dealt["tokens"], strict=True):
                if part != now:
                    if held:
                        yield counted(held)
                    now, held = part, []
                held.append(bytes(tokens))
        if held:
            yield counted(held)
        del held
        give_back()

    # one shuffle has the rows of documents too, or texts would be read twice
    dealt = source.mapInPandas(run, f"part bigint, id {shown}, mark bigint, n bigint, key binary, tokens binary").repartition(parts, "part").sortWithinPartitions("part")
    table = dealt.mapInPandas(count, f"id {shown}, mark bigint, n bigint, key binary, token bigint, c bigint")
    table = durable(table.withColumn("id", F.col("id").cast(kind)), "set-profiles")
    let_go(spark)
    return table


def frequent_tokens(table: DataFrame) -> np.ndarray:
    """The most frequent tokens, sorted; at most `FREQUENT_MOST`."""
    counts = table.filter("token IS NOT NULL").select("token", "c")
    left = FREQUENT_MOST
    from_count = FREQUENT_FROM
    tail = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # a row a count, bounded
    for r in tail:
        left -= r.n
        if left < 0:
            from_count = r.c + 1
            break

    def packed(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"tokens": [batch["token"].to_numpy(dtype=np.int64).tobytes()]})

    rows = counts.filter(F.col("c") >= from_count).select("token").mapInPandas(packed, "tokens binary").collect()  # 8 bytes a token
    return np.sort(np.frombuffer(b"".join(r.tokens for r in rows), dtype=_U))


def meetings(docs: DataFrame, text_col: str, width: int, percent: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Distinct (hub, member) keys of sets that share a signature, of those members that share enough to link at all."""
    often = docs.sparkSession.sparkContext.broadcast(frequent)

    def index(batches):
        import pandas as pd

        def dealt(keys: list[bytes], told: list[tuple[int, int]], sigs: list[np.ndarray]):
            sig = np.concatenate(sigs)
            doc = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(s) for s in sigs])
            part = (sig % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, doc, part = sig[order], doc[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    own, local = np.unique(doc[a:b], return_inverse=True)
                    rows.append((p, _pack(sig[a:b]), local.astype("<u2").tobytes(), b"".join(keys[i] for i in own), np.array([told[i] for i in own], dtype="<u4").tobytes()))
            return pd.DataFrame(rows, columns=["part", "sigs", "doc", "keys", "told"])

        keys, sizes, sigs, known, count = [], [], [], set(), 0
        for batch in batches:
            for s in _few(batch["text"].tolist(), width):
                if len(s) and (key := digest(s)) not in known:
                    known.add(key)
                    keys.append(key)
                    entries, asked = signatures(s, often.value, percent)
                    sizes.append((len(s), asked))
                    sigs.append(entries)
                    count += len(entries)
                    if len(keys) >= 60_000 or count >= 1_500_000:
                        yield dealt(keys, sizes, sigs)
                        keys, sizes, sigs, known, count = [], [], [], set(), 0
        if keys:
            yield dealt(keys, sizes, sigs)
        del keys, sizes, sigs, known
        _rest()

    def gather(rows):
        import pandas as pd

        keys = np.frombuffer(b"".join(rows["keys"]), dtype="V16")
        told = np.frombuffer(b"".join(rows["told"]), dtype="<u4").reshape(-1, 2).astype(np.int64)
        offsets = np.cumsum([0, *[len(x) // 16 for x in rows["keys"]]])
        doc = np.concatenate([np.frombuffer(x, dtype="<u2").astype(np.int64) + o for x, o in zip(rows["doc"], offsets, strict=False)])
        sig = np.concatenate([_unpack(x) for x in rows["sigs"]])
        shown = np.ascontiguousarray(keys).view(">u8").reshape(-1, 2)
        order = np.lexsort((shown[:, 1], shown[:, 0]))
        new = np.r_[True, (shown[order][1:] != shown[order][:-1]).any(axis=1)]
        same = np.empty(len(order), dtype=np.int64)
        same[order] = np.cumsum(new) - 1  # the number of each distinct key, in order of keys
        names, told = keys[order[new]], told[order[new]]
        hub, member, count = _hubs(sig, same[doc], told[:, 0], percent)
        return pd.DataFrame({"hub": [x.tobytes() for x in names[hub]], "member": [x.tobytes() for x in names[member]], "c": count, "asked": told[member, 1]})

    packed = docs.select(F.col(text_col).alias("text")).mapInPandas(index, "part int, sigs binary, doc binary, keys binary, told binary")
    found = packed.groupBy("part").applyInPandas(gather, "hub binary, member binary, c bigint, asked bigint")
    met = durable(found.groupBy("hub", "member").agg(F.sum("c").alias("c"), F.max("asked").alias("asked")), "set-meetings")
    enough = met.groupBy("member").agg(F.sum("c").alias("all"), F.max("asked").alias("least")).filter(F.col("all") >= F.col("least")).select("member")
    return durable(met.select("hub", "member").join(enough, "member"), "set-members")


def sets_of(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the sets whose key is in `wanted`, and of few others.

    What filters them while texts are read is a bitmap, whose size is bounded.
    """
    spark = docs.sparkSession
    keys = max(1, wanted.count())
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (SKETCH_OF_SET * keys - 1).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 32 AS INT)))").alias("bits")).toPandas()
    bitmap = np.zeros(bits // 32, dtype=np.uint32)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)

    import xxhash

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = {}
            for s, more in _few(batch["text"].tolist(), width, wide=True):
                if len(s) and (key := digest(s)) not in rows:
                    p = xxhash.xxh64_intdigest(key, 42) % bits  # as Spark's xxhash64
                    if shared.value[p >> 5] >> np.uint32(p & 31) & np.uint32(1):
                        rows[key] = s.astype("<u8").tobytes() + more.astype("<u8").tobytes()
            yield pd.DataFrame({"key": list(rows), "tokens": list(rows.values())})
        _rest()

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key binary, tokens binary")
    return found.groupBy("key").agg(F.first("tokens").alias("tokens"))


def _with_hub(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows of (hub, member, ...) with what `hubs` has of their hub; a hub's rows go to `SALTS` places, so a large one is no single task's."""
    salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"]).drop("salt")


def _merged(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """Distinct (hub, member) after hubs with common members have been merged.

    Each round a hub takes the least hub that any of its members has, so a set
    travels to fewer places; all that met still meet.  Few rounds keep places small.
    """
    both = pairs.withColumn("place", F.col("hub"))
    for _ in range(rounds):
        of_member = both.groupBy("member").agg(F.min("place").alias("least"))
        of_hub = both.join(of_member, "member").groupBy("hub").agg(F.min("least").alias("place"))
        both = durable(_with_hub(both.select("hub", "member"), of_hub), "hub-places")
    return both.select(F.col("place").alias("hub"), "member").distinct()


def links(docs: DataFrame, *, text_col: str = "text", width: int = 5, percent: int = 75, block: int = 2048, table: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Edges (a, b) between keys of sets: links, enough of them to connect all sets that links connect."""
    table = table if table is not None else profiles(docs, text_col, text_col, width)
    tokens = table.agg(F.sum("n")).first()[0] or 0
    parts = parts or max(PARTS_LEAST, -(-int(tokens) * (100 - percent) // 100 // PART_ENTRIES))
    met = meetings(docs, text_col, width, percent, frequent_tokens(table), parts)
    let_go(docs.sparkSession)
    merged = durable(_merged(met), "places")
    let_go(docs.sparkSession)
    sizes = merged.groupBy("hub").agg(F.count("*").alias("c")).filter("c > 1")
    member = durable(_with_hub(merged, sizes), "places")
    blocks = F.ceil(F.col("c") / block).cast("int")
    mine = F.pmod(F.xxhash64("member"), blocks).cast("int")
    units = member.select("hub", "member", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    units = units.select("hub", "member", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return _verified(units, sets_of(docs, text_col, width, member.select(F.col("member").alias("key"))), percent)


def _verified(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among the members of each unit (hub, i, j)."""
    full = units.join(sets, F.col("member") == F.col("key"))

    def run(batches):
        import pandas as pd

        now, keys, held = None, [], []

        def done():
            return verify(keys, held, percent) if len(keys) > 1 else []

        for batch in batches:
            out = []
            for hub, i, j, key, tokens in zip(batch["hub"], batch["i"], batch["j"], batch["key"], batch["tokens"], strict=True):
                if (hub, i, j) != now:
                    out += done()
                    now, keys, held = (hub, i, j), [], []
                keys.append(bytes(key))
                both = np.frombuffer(tokens, dtype="<u8").reshape(2, -1)
                held.append((both[0], both[1]))
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(done(), columns=["a", "b"])
        del keys, held
        give_back()

    dealt = full.select("hub", "i", "j", "key", "tokens").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInPandas(run, "a binary, b binary")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, block: int = 2048, parts: int | None = None) -> DataFrame:
    """`id_col`, n_shingles and component_id (smallest id reachable by links) of every document."""
    return grouped(docs, id_col=id_col, text_col=text_col, width=width, percent=percent, block=block, parts=parts).select(id_col, "n_shingles", "component_id")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, block: int = 2048, parts: int | None = None) -> DataFrame:
    """As :func:`join`, with `mark` (xxhash64 of the text, null as empty) and `component`, a name that every component of texts with words has for itself."""
    table = profiles(docs, id_col, text_col, width)
    label = components(links(docs, text_col=text_col, width=width, percent=percent, block=block, table=table, parts=parts))
    let_go(docs.sparkSession)
    rows = table.filter("n IS NOT NULL")
    own = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    named = own.join(label, F.col("key") == F.col("node")).select("key", "least", "label")
    group = named.groupBy("label").agg(F.min("least").alias("far"))
    salted = group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a label may have very many keys
    far = named.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"]).select("key", "far", "label")
    places = own.join(far, "key", "left").select("key", F.coalesce("far", "least").alias("component_id"), F.coalesce("label", "key").alias("component"))
    full = rows.filter("n > 0").join(places, "key").select("id", "mark", "n", "component_id", "component")
    empty = rows.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "mark", "component")

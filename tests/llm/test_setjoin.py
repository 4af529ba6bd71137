import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import setjoin
from tessella.llm.graph import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def same(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = [tuple(r) for r in setjoin.join(df, **how).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def copies(seed, groups, size):
    """Groups of copies at all distances, and passages that many texts share."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [[rnd.choice(vocab) for _ in range(60)] for _ in range(3)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 8, 40, 120]))]
        if rnd.random() < 0.5:
            base += rnd.choice(shared)
        for _ in range(rnd.randrange(1, size)):
            text = list(base)
            for _ in range(rnd.randrange(0, 1 + len(text) // 25)):
                text[rnd.randrange(len(text))] = rnd.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(spark, rows)


@pytest.mark.parametrize("how", [{}, {"block": 4, "parts": 3}])
def test_copies_and_passages(spark, how, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT_FROM", 3)
    same(spark, copies(1, 30, 12), **how)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE\ttwo "), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (9, "a " * 20000), (10, "A " * 9000), (None, "one two"), (None, None), (11, "a b c"), (4, "one two"), (12, "x\x1cy z")]
    same(spark, rows)
    same(spark, [(None, "only null"), (None, "only null")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.join(empty).count() == 0


def test_signatures_lose_no_pair():
    """Any two linked sets share a signature, whatever counts as frequent."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(6000):
        span = int(rng.choice([400, 4000]))
        n = int(rng.integers(1, 60) if rng.random() < 0.5 else rng.integers(60, 300))
        x = rng.integers(0, span, n).astype(np.uint64)
        y = x.copy()
        y[: rng.integers(0, n // 3 + 1)] = rng.integers(0, span)
        x, y = np.unique(np.r_[x, rng.integers(0, span, rng.integers(0, 4)).astype(np.uint64)]), np.unique(y)
        frequent = np.sort(rng.choice(span, int(rng.integers(0, span // 2 if rng.random() < 0.7 else span)), replace=False)).astype(np.uint64)
        if (x == y[:1]).any() and len(x) == len(y) and (x == y).all():
            continue
        if setjoin.linked(len(x), len(y), len(np.intersect1d(x, y)), 75):
            found += 1
            (a, least_a), (b, least_b) = setjoin.signatures(x, frequent, 75), setjoin.signatures(y, frequent, 75)
            common = np.intersect1d(a, b).size
            assert common >= max(1, least_a, least_b)
    assert found > 500


def test_links_are_verified_on_all_bits():
    """Sets that agree in the first 64 bits of their tokens, but not in the others, don't link."""
    first = np.arange(1, 41, dtype=np.uint64)
    a, b, c = (first, first * np.uint64(3)), (first, first * np.uint64(5)), (first, np.r_[first[:36] * np.uint64(3), first[36:]])
    assert setjoin.verify([b"a", b"b"], [a, b], 75) == []
    assert setjoin.verify([b"a", b"b", b"c"], [a, b, c], 75) == [(b"a", b"c")]
    many = [b"%03d" % i for i in range(40)]
    assert setjoin.verify(many, [(first, first * np.uint64(2 * i + 1)) for i in range(40)], 75) == []
    assert len(setjoin.verify(many, [a] * 40, 75)) == 39


def test_a_token_that_every_chunk_has_once_is_counted(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "ONCE_IN", 2)
    rnd = random.Random(9)
    rows = [(i, "one passage of five words " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20))) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    token = setjoin.token_sets(["one passage of five words"])[0][0]
    table = setjoin.profiles(df, "doc_id", "text", 5)
    found = table.filter(f"token = {int(np.uint64(token).view(np.int64))}").selectExpr("sum(abs(c))").first()[0]
    assert 20 <= found <= 110
    assert setjoin.frequent_tokens(table).tolist() == [token]


def test_large_places(spark, monkeypatch):
    """Hubs of many blocks: near copies in one, and unlike sets that share their frequent tokens."""
    monkeypatch.setattr(setjoin, "FREQUENT_FROM", 3)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        text[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(text)))
    part = [[f"p{k}-{i}" for i in range(30)] for k in range(6)]
    for i in range(60):
        rows.append((100 + i, " ".join(part[i % 6] + part[(i // 6) % 6] + [f"u{i}"])))
    same(spark, rows, block=5, parts=2)


def test_token_sets_match_words(monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK_BYTES", 50)
    texts = [t for _, t in copies(4, 20, 4)] + [None, "", "a", "\ta  b\n", "É É É É É É"]
    for text, tokens in zip(texts, setjoin.token_sets(texts), strict=True):
        assert len(tokens) == len(shingles(text))
    for narrow, (tokens, more) in zip(setjoin.token_sets(texts), setjoin.token_sets(texts, wide=True), strict=True):
        assert (narrow == tokens).all() and len(more) == len(tokens) and not np.isin(more, tokens).any()


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_every_token_is_counted(spark, monkeypatch):
    """Of all documents, also where each chunk has a token once; equal sets of a chunk count once."""
    monkeypatch.setattr(setjoin, "PART_BYTES", 1000)
    rnd = random.Random(10)
    passages = [f"passage {k} of five words" for k in range(12)]
    rows = [(i, " ".join([p for k, p in enumerate(passages) if i % 12 <= k] + [f"w{rnd.randrange(10**6)}" for _ in range(6)])) for i in range(48)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(48)
    want = Counter(t for _, text in rows for t in {int(x) for x in setjoin.token_sets([text])[0]})
    table = setjoin.profiles(df, "doc_id", "text", 5)
    got = {int(np.int64(r.token).view(np.uint64)): r.c for r in table.filter("token IS NOT NULL").collect()}
    assert got == {t: c for t, c in want.items() if c >= setjoin.FREQUENT_FROM} and len(set(got.values())) > 3
    assert setjoin.frequent_tokens(table).tolist() == sorted(got)
    assert table.filter("n IS NOT NULL").count() == len(rows)
    most = sorted(want.values(), reverse=True)[4]
    monkeypatch.setattr(setjoin, "FREQUENT_MOST", sum(c > most for c in want.values()) + 1)
    assert setjoin.frequent_tokens(table).tolist() == sorted(t for t, c in want.items() if c > most)


def test_large_ids_beside_one_that_is_null(spark):
    rows = [((1 << 60) + i, f"a b c d e {i // 2}") for i in range(1, 9)] + [(None, "f g h i j"), (None, None)]
    got = setjoin.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {r.doc_id: r.component_id for r in got.collect()} == {None: None} | {(1 << 60) + i: (1 << 60) + max(1, i // 2 * 2) for i in range(1, 9)}

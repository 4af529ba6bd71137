import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import token_file
from tessella.llm.entries import vocabulary


def test_elias_fano():
    rnd = random.Random(1)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (5, 3), (3000, 10), (3000, 10**9), (2000, 2**40)):
        v = np.sort(np.array([rnd.randrange(top + 1) for _ in range(n)], dtype=np.int64))
        code = token_file.EliasFano.build(v)
        assert code.between(0, n).tolist() == v.tolist()
        for i, j in ((0, 1), (n // 3, n // 2), (n // 2, n), (n, n + 5)):
            assert code.between(i, j).tolist() == v[i:j].tolist()
        if n:
            for x in (int(v[0]), int(v[n // 2]), int(v[-1]) + 1):
                assert code.last_at_most(x, 0) == int(np.searchsorted(v, x, side="right")) - 1
        for i in range(0, n, 7):
            assert code.select(i) == v[i]
        if n > 1000:
            assert sum(map(len, code.parts())) < n * (3 + max(0, np.log2(max(top, 1) / n))) / 8 + 64


def test_small_blocks(spark, monkeypatch):
    """Reading in blocks of few ids and documents gives the same, and no table of all offsets is made."""
    rows = [(i // 2, f"word {i} " * (i % 40)) for i in range(300)]
    manifest = token_file.write(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), end_id=2)
    for r in manifest.collect():
        reader = token_file.Reader(r.uri)
        whole = [(d, at, ids.tolist()) for d, at, ids in reader.documents()]
        monkeypatch.setattr(token_file, "READ_IDS", 50)
        monkeypatch.setattr(token_file, "READ_DOCS", 7)
        assert [(d, at, ids.tolist()) for d, at, ids in reader.documents()] == whole
        assert [(d, ids) for d, _, ids in whole] == [(d, reader.document(i).tolist()) for i, d in enumerate(reader.doc_ids())]
        monkeypatch.undo()


def test_round_trip(spark):
    rows = [(5, "b b"), (None, "n"), (-3, None), (7, ""), (2**40, "big id"), (5, "a a"), (9, "long " * 4000)] + [(100 + i, f"doc {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    manifest = token_file.write(df, vocabulary(), end_id=2, file_bytes=5000)
    got = token_file.read(manifest, keep_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(vocabulary())
    marks = {r[0]: r[1] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
    assert manifest.count() > 2
    at = 0
    assert len(got) == len(want)
    for r, (doc, text) in zip(got, want, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.token_ids)) == (doc, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert token_file.read(token_file.write(df.limit(0), vocabulary(), end_id=2)).count() == 0
    one = token_file.Reader(manifest.orderBy("first_id").filter("n_docs > 20").first().uri)
    named = list(one.documents())
    for i in (0, len(one) - 1, len(one) // 2):
        assert one.document(i).tolist() == named[i][2].tolist()


def test_pieces_are_told_apart_by_their_spaces():
    tool = token_file.LibraryEncoder(vocabulary())
    alone = lambda piece: np.array(tool.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
    pieces = {f" {w}" for w in ("the", "a,b", "x\ty", "line\nnext", "12.5", "don't", "É", "\u4f60\u597d", "a\u00a0b", "z" * 150)} | {"plain", " ", "  ", " two words", " end\n", " \t", " " + "q" * 300}
    want = {piece: alone(piece) for piece in pieces}
    assert tool.encode_pieces(pieces) == want
    tool.opens = np.zeros_like(tool.opens)  # no group can be told apart
    assert tool.encode_pieces(pieces) == want


def test_words_and_marks_of_pieces_are_encoded_once():
    tool = token_file.LibraryEncoder(vocabulary())
    seen, encode_new = [], tool.encode_new
    tool.encode_new = lambda parts: seen.extend(parts) or encode_new(parts)
    texts = ["a river stone", "a river, stone.\nriver stone", "stone! river", "z" * 90 + " " + "y" * 90 + ". river.", None, "\u00e9\u3000 x", " river  stone,", "a<|endoftext|> river."]
    for text in texts:
        ids = tool.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert tool.encode(text) == ids == tool.encode(text)
        if text == texts[1]:
            assert sorted(seen) == sorted(["a", " river", " stone", ",", ".", "\n", "river"])
    assert max(map(len, [*tool._plain, *tool._after])) <= 60  # long pieces aren't kept


def test_pieces_of_many_texts_are_looked_up_once(monkeypatch):
    tool = token_file.LibraryEncoder(vocabulary())
    texts = [
        "a river, stone.\nriver stone! " * 30, None, "", " ", "word", " lead", "trail ", "two  spaces here", "x 　 y", "a<|endoftext|> river,", "<|endoftext|>", "line\n next\n\n last", "12. 3.5, 你好, é. z.",
        "z" * 90 + " " + "y" * 90 + ". " + "y" * 90 + " " + "y" * 90 + ".\nriver", "it's . , a. b, I. \t. \n.", "\ta b\r\n c",
    ]
    want = [np.array(tool.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for text in texts]

    class Counted(dict):
        seen = 0

        def get(self, *args):
            Counted.seen += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    tool._after, tool._plain = Counted(tool._after), Counted(tool._plain)
    assert list(tool.encode_packed(texts * 40)) == want * 40
    assert Counted.seen < 200  # the texts have some 6000 pieces
    for chars, most in ((1, 1), (40, 5), (300, 1_000_000)):
        monkeypatch.setattr(token_file.LibraryEncoder, "cut_chars", chars)
        monkeypatch.setattr(token_file.LibraryEncoder, "most_known", most)
        assert list(tool.encode_packed(texts * 2)) == want * 2
        assert list(token_file.LibraryEncoder(vocabulary()).encode_packed(texts)) == want
    assert max(map(len, [*tool._plain, *tool._after])) <= 60

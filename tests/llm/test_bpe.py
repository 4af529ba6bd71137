import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe
from tessella.llm.entries import vocabulary

TEXTS = [
    None, "", " ", "   ", "a", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x", "x" * 5000, "it's we'LL  \n\n x ", "foo\n bar", "foo \nbar", "foo\n \nbar", "a   b",
    " lead", "trail ", "²³ Ⅷ ٣", "\u0085b  c\x1c\x1d", "中文字符 日本語", "🙂🙂 👩‍👩‍👧", "՘x Ᲊy ₏z", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_matches_library(library):
    own = bpe.TrieBpe(vocabulary())
    for text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode_packed(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_small_cache_and_batches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "TRIE_CHARS", 10)
    monkeypatch.setattr(bpe, "CACHE_WORD_CHARS", 2)
    own = bpe.TrieBpe(vocabulary())
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode_packed(TEXTS)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_random_texts(library):
    import random

    rnd, own = random.Random(5), bpe.TrieBpe(vocabulary())
    for _ in range(2000):
        text = "".join(rnd.choice([" ", "\n", "'s", "a", chr(rnd.randrange(32, 127)), chr(rnd.randrange(9, 0x500)), chr(rnd.randrange(0xE000, 0x1FFFF))]) for _ in range(14))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_over_frame(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a", "x"), (0, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, vocabulary(), keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert hashlib.sha256(bytes(r.token_ids)).hexdigest() == r.ids_sha256
    by_id = {r.doc_id: r for r in got if r.doc_id}
    for i, t in enumerate(TEXTS[1:], 1):
        assert by_id[i].decoded == t and by_id[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids)
    assert bpe.round_trip(df.limit(0), vocabulary()).count() == 0
    packed = bpe.encode(df, vocabulary()).filter("doc_id = 4").first()
    assert np.frombuffer(packed.token_ids, dtype="<u4").tolist() == library.encode("a", add_special_tokens=False).ids


def test_every_white_space_before_a_space(library):
    own = bpe.TrieBpe(vocabulary())
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or not chr(c).isprintable()][:400]
    for c in [*spaces, *(mark[0] for mark in bpe.BREAKS)]:
        for text in (f"a{c} b", f"\u00e9{c} {c}b", f"a\n{c} \u4e2d c", f"x {c}y", f"{c} "):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)


def test_words_in_sorted_order_share_states_and_pairs_are_judged_once():
    import random

    rnd, own = random.Random(7), bpe.TrieBpe(vocabulary())
    words = {"".join(rnd.choice([" the", "th", "e", "ing", "tion", "\u00e9", "\u4e2d", "qx", "z"]) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)}
    words |= {w[:n] for w in list(words)[:300] for n in range(1, len(w))} | {"x" * 3000, "", "\U0001f642" * 40}
    judged, follows = [], own._follows
    own._follows = lambda left, right: judged.append((left, right)) or follows(left, right)
    shuffled = list(words)
    rnd.shuffle(shuffled)
    for part in (shuffled[:2000], shuffled[2000:], shuffled):
        found = own.encode_words(part)
        assert {w: np.frombuffer(found[w], dtype="<u4").tolist() for w in part} == {w: own.merge(w.encode()) for w in part}
    assert len(judged) == len(set(judged)) > 100


def test_first_pieces_stay_when_a_worker_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    monkeypatch.setattr(bpe, "TRIE_CHARS", 20)
    own = bpe.TrieBpe(vocabulary())
    texts = ["the river stone and <|endoftext|> paper", *(f"w{i} the q{i} and" for i in range(200))]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode_packed(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"river", "stone", "and", "paper"} - set(own._after) <= {"paper"} and len(own._after) + len(own._plain) < 100

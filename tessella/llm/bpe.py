"""BPE encoding and decoding by prefix-sharing trie traversal.

Byte-pair encoding of a byte string is determined by the encodings of its
prefixes: the encoding of a prefix ends in exactly one token `t`, which is a
suffix of the prefix, and what stands before it is the encoding of the shorter
prefix.  `t` is the one suffix token whose pair with the last token of that
shorter prefix survives encoding as it is.  So one *last-token state* per prefix
is enough.  The distinct words of a batch form a trie; a depth-first walk, which is
their sorted order, computes the state of every node once, so words with a common
beginning share its work; a word's ids are read backwards along the states of its path.

Nulls count as empty texts, empty texts have no tokens, and repeated rows give
repeated results.  Extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import worker_cache

#: Fixed value: the split into words of byte-level BPE vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers before it starts afresh, and characters of
#: the longest such word; both bound memory only.
CACHE_WORDS, CACHE_WORD_CHARS = 1_500_000, 60
#: Pairs of tokens of which a worker remembers whether they stay apart.
PAIRS = 500_000
#: Characters of text whose words are put into one trie.
TRIE_CHARS = 1_000_000
#: White space other than the space, before a space: there a cut at spaces may not be one between words.
BREAKS = tuple(chr(c) + " " for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 32))
#: All of those that a text can have whose characters are printable but for line breaks: no other white space is.
PLAIN_BREAKS = ("\n ", "  ")
#: Marks that are words at the end of a piece.
MARKS = ".,;:!?"
#: After one of those breaks a space that white space follows.
TANGLED = re.compile(r"\s \s|  ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _pack(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


class TrieBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file (``tokenizer.json``)."""

    #: Pieces that a worker remembers, if other than `CACHE_WORDS`, and characters of text that are cut at a time, if other than `TRIE_CHARS`.
    most_known: int | None = None
    cut_chars: int | None = None

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda shown: bytes(alphabet[c] for c in shown)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = raw(left), raw(right)
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        # every beginning of a token, with the token's id where it is whole
        self.starts = {t[:n]: -1 for t in self.ids for n in range(1, len(t))} | self.ids
        self.rank = [-1] * size
        self.halves = [(0, 0)] * size
        for (left, right), (rank, whole) in self.merges.items():
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = rank, (left, right)
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = self._newer_letters()
        self.path = path
        self._library = None
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._after: dict[str, bytes] = {}
        self._plain: dict[str, bytes] = {}
        self._forget()

    @staticmethod
    def _newer_letters():
        """Letters and digits that only the `regex` library's Unicode tables have.

        Words that hold one are split by the tokenizers library, whose tables lie
        between those and Python's own.
        """
        runs: list[list[int]] = []
        for char in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0x80, 0x110000)))):
            if unicodedata.category(char) == "Cn":
                if runs and runs[-1][1] == ord(char) - 1:
                    runs[-1][1] += 1
                else:
                    runs.append([ord(char)] * 2)
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]") if runs else None

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: the lowest-ranked, leftmost pair merges first."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts

    def _stands(self, token: int) -> bool:
        """Does the token's own byte string encode as that one token?"""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Do two neighbouring tokens stay apart?

        Goes back in time over the merges that built them.  The pieces that touch
        at the border exist together until the next of those merges; if they could
        have merged with each other before it, the two tokens never come about.
        At equal ranks the leftmost pair merges first.
        """
        rank, halves, merges = self.rank, self.halves, self.merges
        until = len(merges) + 1
        while True:
            meeting = merges.get((left, right))
            if meeting is not None and meeting[0] < until:
                return False
            if (formed := rank[left]) > rank[right]:
                until = formed
                left = halves[left][1]
            elif (formed := rank[right]) >= 0:
                until = formed + 1
                right = halves[right][0]
            else:
                return True

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, packed as little-endian unsigned 32-bit integers.

        In sorted order words are the leaves of the trie from left to right, so a list by
        depth holds the states on the way to a word, and those of the beginning that it
        shares with the word before stay.
        """
        held = sorted((word.encode(), word) for word in words)
        found: dict[str, bytes] = {"": b""}
        deepest = max((len(data) for data, _ in held), default=0)
        # by depth on the path of the word before: the last token, where it begins, and where a token under way may begin
        last, start_of, reach = [0] * (deepest + 1), [0] * (deepest + 1), [0] * (deepest + 1)
        state, stands, follows, pairs = self.starts.get, self._stands, self._follows, self._pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        shift = len(self.bytes_of)
        before = b""
        for data, word in held:
            shared = 0
            for a, b in zip(before, data):  # noqa: B905 - up to the end of the shorter
                if a != b:
                    break
                shared += 1
            before = data
            start = reach[shared]
            for depth in range(shared + 1, len(data) + 1):
                while (token := state(data[start:depth])) is None:
                    start += 1
                at = reach[depth] = start
                while True:
                    if token is not None and token >= 0:
                        if not at:
                            if stands(token):
                                break
                        else:
                            pair = last[at] * shift + token
                            if (apart := pairs.get(pair)) is None:
                                apart = pairs[pair] = follows(last[at], token)
                            if apart:
                                break
                    at += 1
                    token = state(data[at:depth])
                last[depth], start_of[depth] = token, at
            at, back = len(data), []
            while at:
                back.append(last[at])
                at = start_of[at]
            back.reverse()
            found[word] = _pack(back)
        return found

    def _words(self, text: str) -> list[str]:
        if self.odd and self.odd.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _uncut(self, text: str) -> list[str] | None:
        """The words of a text that single spaces would cut inside of a word, or None."""
        if self.special and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        for mark in PLAIN_BREAKS if text.replace("\n", "").isprintable() else BREAKS:
            if mark in text:
                return self._words(text) if TANGLED.search(text) else None
        return None

    def _cut(self, text: str) -> list[tuple[dict, list[str]]]:
        """Cut a text at single spaces, or where that would cut a word, into words.

        Each piece is a run of whole words, so pieces are encoded on their own; most
        recur, and are looked up.  Comes with the table that knows the pieces:
        `_after` for pieces behind a space, which is left out, `_plain` for others.
        """
        if (words := self._uncut(text)) is not None:
            return [(self._plain, words)]
        first, *rest = text.split(" ")
        return [(self._plain, [first]), (self._after, rest)]

    def encode_packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The packed ids of each text, in order; memory is bounded by `TRIE_CHARS` and the longest text."""
        held, chars = [], 0
        for text in texts:
            held.append(self._cut(text or ""))
            chars += len(text or "")
            if chars >= (self.cut_chars or TRIE_CHARS):
                yield from self._join(held)
                held, chars = [], 0
        yield from self._join(held)

    def _join(self, held: list[list[tuple[dict, list[str]]]]) -> list[bytes]:
        """The packed ids of each text: what isn't known of all is encoded and told the tables, so that each piece is one look-up."""
        if len(self._after) + len(self._plain) > (most := self.most_known or CACHE_WORDS):
            self._forget(most // 4)
        fresh = [(table, space, list(set().union(*[pieces for parts in held for t, pieces in parts if t is table]).difference(table))) for table, space in ((self._after, " "), (self._plain, ""))]
        named = [[space + piece for piece in pieces] if space else pieces for _, space, pieces in fresh]
        if any(named):
            found = self.encode_pieces(set().union(*named))
            for (table, _, pieces), names in zip(fresh, named, strict=True):
                table.update(zip(pieces, map(found.__getitem__, names), strict=True))
        join = b"".join
        out = [join([join(map(table.__getitem__, pieces)) for table, pieces in parts]) for parts in held]
        for table, _, pieces in fresh:
            for piece in pieces:
                if len(piece) > CACHE_WORD_CHARS:
                    del table[piece]
        return out

    def _forget(self, kept: int = 0) -> None:
        """Drop all pieces but the `kept` that came first, which recur most."""
        for table in (self._after, self._plain):
            first = list(islice(table.items(), kept))
            table.clear()
            table.update(first)
        self._plain.update({s: struct.pack("<I", i) for s, i in self.special.items()})

    def _remember(self, piece: str, packed: bytes) -> None:
        if len(piece) <= CACHE_WORD_CHARS:
            if piece[:1] == " ":
                self._after[piece[1:]] = packed
            else:
                self._plain[piece] = packed

    def _recall(self, word: str) -> bytes | None:
        return self._after.get(word[1:]) if word[:1] == " " else self._plain.get(word)

    @staticmethod
    def _parts(piece: str) -> list[str]:
        """Parts of a piece that certainly are whole words or runs of them.

        A line break between two that aren't white space is a word, and so is a mark
        at the end behind a letter.
        """
        lines = piece.split("\n")
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in (lines[0][1:] or lines[0], *lines[1:])):
            lines = [piece]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            if len(line) > 2 and line[-1] in MARKS and line[-2].isalpha():
                out.append(line[:-1])
                out.append(line[-1])
            else:
                out.append(line)
        return out

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces; only the parts that aren't known are encoded."""
        was_on = gc.isenabled()
        gc.disable()  # many lists and no cycles
        try:
            whole, split = [], {}
            for piece in pieces:
                if ("\n" in piece or piece[-1:] in MARKS) and len(parts := self._parts(piece)) > 1:
                    split[piece] = parts
                else:
                    whole.append(piece)
            coded = {part: self._recall(part) for part in set().union(*split.values())}
            parts = [part for part, known in coded.items() if known is None]
            fresh = self.encode_new(list({*whole, *parts}))
            for part in parts:
                coded[part] = fresh[part]
                self._remember(part, fresh[part])
            found = {piece: b"".join(map(coded.__getitem__, parts)) for piece, parts in split.items()}
            found.update(zip(whole, map(fresh.__getitem__, whole), strict=True))
            return found
        finally:
            if was_on:
                gc.enable()

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct parts: their distinct new words go through one trie."""
        split = {part: [part] if part.isalpha() or (part[:1] == " " and part[1:].isalpha()) else self._words(part) for part in parts}
        coded = {word: self._recall(word) for word in set().union(*split.values())}
        fresh = self.encode_words([word for word, known in coded.items() if known is None])
        for word, packed in fresh.items():
            self._remember(word, packed)
        coded |= fresh
        return {part: coded[words[0]] if len(words) == 1 else b"".join(map(coded.__getitem__, words)) for part, words in split.items()}

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_packed([text])), dtype="<u4").tolist()

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


def calm_collector() -> None:
    """Look for cycles less often: encoding makes many lists of strings, and no cycles."""
    gc.set_threshold(200_000, 20, 100)


def load(path: str) -> TrieBpe:
    """The encoder of a vocabulary file, read once per worker."""
    kept = worker_cache("bpe")
    if path not in kept:
        calm_collector()
        kept[path] = TrieBpe(path)
    return kept[path]


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, token_ids (packed little-endian unsigned 32-bit) of every whole text."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            yield batch[["id"]].assign(token_ids=list(bpe.encode_packed(batch["text"].tolist())))

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(run, f"id {kind}, token_ids binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, remember: int | None = None) -> DataFrame:
    """Encode every text, decode its ids again, and return digests of both.

    Columns: `id_col`, n_tokens, ids_sha256, decoded_sha256, and with `keep_text`
    the packed token_ids and the decoded text.  `remember` is how many pieces of
    text a worker may remember, where memory is short; results don't depend on it.
    """

    def run(batches):
        import pandas as pd

        bpe = load(vocabulary)
        bpe.most_known = remember
        for batch in batches:
            rows = []
            for packed in bpe.encode_packed(batch["text"].tolist()):
                text = bpe.decode_packed(packed)
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, packed, text) if keep_text else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * keep_text
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    more = ", token_ids binary, decoded string" if keep_text else ""
    return source.mapInPandas(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)

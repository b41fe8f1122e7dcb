"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that can end its encoding. An automaton over the
vocabulary lists the tokens that end at each position; a token is the one sought if the prefix before it ends in a
token with which it forms a pair that merging would leave alone. Following the last tokens back gives exactly the ids
that merging in rank order gives, in time linear in the pre-token.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from strata.llm.common import map_rows, texts

# The pre-token pattern of this family of byte-level vocabularies. White space is Unicode's.
WHITE = r"\p{White_Space}"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|{WHITE}+(?![^{WHITE}])|{WHITE}+"
NEVER = 1 << 30
CACHED, PAIRS = 300_000, 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such a vocabulary: itself if printable, else the next from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Unsplittable(Exception):
    """A chunk between single spaces whose white space touches the chunk's edge."""


class Chunks(dict):
    """Ids (as bytes) of text chunks met so far; of two generations the older goes when the newer is full."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unsplittable
            ids = self.encode(self.lead + chunk)
        if len(chunk) <= 48:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class BytePairs:
    """A vocabulary file of the `tokenizers` library (byte-level BPE), for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(map(to_byte.__getitem__, s)): i for s, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for b, i in vocab.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.sizes = [len(b) for b in self.bytes]
        self.lengths = np.array(self.sizes, np.int64)
        split = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank, self.made, self.parts = {}, {}, {}
        for r, (a, b) in enumerate(split):
            left, right = (bytes(map(to_byte.__getitem__, x)) for x in (a, b))
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = r
            self.parts.setdefault(whole, (*pair, r))
        self.right, self.left, self.pairs = {}, {}, {}
        automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            if self._whole(i):
                automaton.add_word(b.decode("latin-1"), (i, len(b)))
        automaton.make_automaton()
        self.automaton = automaton
        self.pattern = regex.compile(PRETOKEN)
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words: dict[str, bytes] = {}
        self.first, self.rest = Chunks(self._pretokens, ""), Chunks(self._pretokens, " ")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the token's right (side 1) or left (0) end while it is merged, each with the rank of the merge that takes it in."""
        known = self.right if side else self.left
        if token not in known:
            edge, taken = [(token, NEVER)], token
            while taken in self.parts:
                *pair, r = self.parts[taken]
                edge.append((pair[side], r))
                taken = pair[side]
            known[token] = edge
        return known[token]

    def _crossed(self, one: int, two: int, before: int) -> bool:
        """Would a merge of rank < before join the end of `one` to the start of `two`? Of equal ranks the merge further left comes first."""
        rank = self.rank
        for a, until_a in self._edge(one, 1):
            for b, until_b in self._edge(two, 0):
                r = rank.get((a, b), NEVER)
                if r < before and r < until_a and r <= until_b:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Do the token's own bytes encode to it?"""
        todo = [token]
        while todo:
            if (t := todo.pop()) in self.parts:
                left, right, r = self.parts[t]
                if self._crossed(left, right, r):
                    return False
                todo += [left, right]
        return True

    def _apart(self, key: int) -> bool:
        """Do the two tokens of the key (the first, 20 bits further left than the second) stay apart? Kept for later."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[key] = not self._crossed(key >> 20, key & 0xFFFFF, NEVER)
        return found

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, known, apart = len(data), self.pairs.get, self._apart
        last = [-1] * n  # by the prefix's last byte
        for end, (token, k) in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                if k > end:
                    last[end] = token
                else:
                    key = last[end - k] << 20 | token
                    if known(key) or (known(key) is None and apart(key)):
                        last[end] = token
        ids, sizes, n = [], self.sizes, n - 1
        while n >= 0:
            ids.append(last[n])
            n -= sizes[last[n]]
        return ids[::-1]

    def _pretokens(self, text: str) -> bytes:
        out, words = [], self.words
        # of letters alone, but for a space before them, there is one pre-token
        for w in (text,) if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else self.pattern.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = pack(self.piece(w.encode("utf-8", "replace")))
                if len(w) <= 48:
                    if len(words) >= CACHED:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        # A single space after a chunk starts a pre-token; so each chunk between such spaces has ids of its own.
        chunks = text.split(" ")
        try:
            return self.first[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))
        except Unsplittable:
            return self._pretokens(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Strings of added tokens become those tokens."""
        if not self.added or not any(s in text for s in self.added):
            return self._plain(text)
        return b"".join(pack([self.added[x]]) if x in self.added else self._plain(x) for x in self.added_pattern.split(text) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character, and character after the last, of each token; tokens that share a character both have it."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) == len(text):
            return starts, ends
        nth = np.cumsum((data & 0xC0) != 0x80)  # of each byte: its character, from 1
        return nth[starts] - 1, nth[ends - 1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    """One per Python worker: it outlives tasks, with its caches."""
    return BytePairs(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) of every whole text; no special tokens are added.

    docs: doc_id, text; other columns are ignored. A null or empty text has no ids; repeated rows give repeated rows; an
    empty table gives an empty one. path: a vocabulary file that every executor has at that place.
    """
    path = path or public_vocabulary()

    def make():
        pairs, last, ids = vocabulary(path), "", np.zeros(0, "<i4")

        def handle(batch):
            nonlocal last, ids
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text != last:  # copies that a mix makes of a document follow each other
                    last, ids = text, np.frombuffer(pairs.encode(text), "<i4")
                yield doc, len(ids), ids
        return handle

    return map_rows(texts(docs), make, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: empty). Bytes that aren't UTF-8 become the replacement character."""
    path = path or public_vocabulary()

    def make():
        pairs = vocabulary(path)

        def handle(batch):
            for doc, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                yield doc, pairs.decode(np.array(ids or [], "<u4").tobytes())
        return handle

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of the decoded text.

    Same inputs and edge cases as encode_documents; the digests of an empty text are those of no bytes.
    """
    path = path or public_vocabulary()

    def make():
        pairs = vocabulary(path)

        def handle(batch):
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = pairs.encode(text)
                back = pairs.decode(ids).encode()
                yield doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)
        return handle

    return map_rows(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")

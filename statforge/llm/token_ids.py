"""Token ids of whole texts, exactly as the tokenizers library gives them.

Both vocabularies never merge across a single space that stands between two
characters other than white space, nor across a line feed that does, so a text may
be cut there and each piece be encoded alone. Pieces repeat, and a bounded cache keeps the ids of those seen;
only new pieces reach the library. Texts with other white space around spaces are
cut by a look-around pattern, and texts that hold the string of a special token are
encoded whole, so that the library's own handling of them applies.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: White space besides space and line feed, as Unicode has it.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: What str.split() takes for white space and the tokenizers library does not.
NOT_SPACE_IN_TOKENIZERS = "\x1c\x1d\x1e\x1f"
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Next to other white space a line feed may share a token with it (line feed and U+00A0 do).
LONE_FEED = re.compile(r"(?<=\S)\n(?=\S)")
#: Byte-level vocabularies write each byte as a printable sign: itself where it has one,
#: else the next free code point from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
SPACE_SIGN = chr(BYTE_SIGNS[32])
#: ASCII punctuation but the apostrophe, which contractions use: never in one token with letters.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer pieces are not worth a place in the cache.
LONG = 200


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(text: str) -> list[str]:
    """The text cut at spaces that no token spans; the spaces are left out."""
    parts = text.split(" ")
    if "" in parts or "\n " in text or " \n" in text or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)):
        return INNER_SPACE.split(text)
    return parts


class Pieces(dict):
    """piece -> value, worked out by ``learn`` when a piece is first asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str):
        return self.learn(piece)


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of a Python worker, which keeps the pieces it knows from task to task."""
    return PieceEncoder(path)


class PieceEncoder:
    """``encode(texts)`` gives the ids of each text as little-endian bytes.

    head: pieces at the start of a text or line; rest: pieces after a space. In a
    byte-level vocabulary the space belongs to the piece; where white space is dropped
    both are the same. About ``limit`` pieces are remembered.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.line = self._library("\n")
        self.head = Pieces(lambda piece: self._learn(piece, self.head, ""))
        self.rest = Pieces(lambda piece: self._learn(piece, self.rest, " ")) if self.line else self.head

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word of Latin letters is one pre-token: the library's model alone merges it."""
        if not self.line:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = [t.id for t in self.model.tokenize(word.replace(" ", SPACE_SIGN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, piece: str, known: Pieces, lead: str) -> bytes:
        if "\n" in piece:
            lines = LONE_FEED.split(piece)
            if len(lines) > 1:
                return known[lines[0]] + b"".join([self.line + self.head[x] for x in lines[1:]])
        word = piece.rstrip(STOPS)
        if not word.isalpha() or max(word) > "\xff":
            value = self._library(lead + piece)
        elif len(word) < len(piece):
            value = known[word] + self.head[piece[len(word) :]]
        else:
            value = self._word(lead + word)
        if len(piece) <= LONG:
            known[piece] = value
        return value

    def _make_room(self) -> None:
        if len(self.rest) + (0 if self.head is self.rest else len(self.head)) > self.limit:
            self.head.clear()
            self.rest.clear()

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each closed by ``end_id``; where each text
        starts, and the end). For a vocabulary that drops white space: the column is split
        into words at once, each distinct word is encoded once, and its ids are gathered."""
        if self.line:
            raise ValueError("only for a vocabulary that drops white space")
        self._make_room()
        words = pa.compute.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        edges = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        known = [*map(self.rest.__getitem__, coded.dictionary.to_pylist()), struct.pack("<I", end_id)]
        ids = np.frombuffer(b"".join(known), "<i4")
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        ends = edges[1:] - edges[0] + np.arange(len(texts))
        codes = np.full(len(coded) + len(texts), len(known) - 1)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        codes[inner] = coded.indices.to_numpy()
        size = lengths[codes]
        upto = np.cumsum(size)
        flat = ids[np.repeat(starts[codes] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        return flat, np.concatenate([[0], upto[ends]]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            self._make_room()
            if any(s in text for s in self.special):
                out.append(self._library(text))
                continue
            if not self.line and not any(c in text for c in NOT_SPACE_IN_TOKENIZERS):
                text = text.lower() if text.isascii() else text
                out.append(b"".join(map(self.rest.__getitem__, text.split())))
                continue
            first, *others = pieces_of(text)
            out.append((self.head[first] if first else b"") + b"".join(map(self.rest.__getitem__, others)))
        return out

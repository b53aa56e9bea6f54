"""Byte-level BPE by longest matches and backtracking.

The bytes of a piece are mapped to Latin-1 characters, one each, so that the trie of an Aho-Corasick automaton
over the vocabulary finds the longest token that can begin at a position. From the left, the longest token is taken that can
stand beside the token before it; where none can, the last token gives way to its next shorter one. Two tokens
can stand side by side if merging their joined bytes by rank leaves exactly these two; that is memoised.
A position from which no way leads on is never entered twice, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Memo, released, ship

#: Unicode white space, stated so that every engine means the same by it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEVER = 1 << 60

#: Fixed value: the pattern that can be spelled out for Latin-1.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile("[\x00-\xff]*").fullmatch


def spelled_out(pattern: str) -> str:
    """WORDS with its classes as the characters that they hold among the first 256."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    space = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    for name, inner in ((r"[^\s\p{L}\p{N}]", f"[^{space}{of('L')}{of('N')}]"), (r"\p{L}", f"[{of('L')}]"), (r"\p{N}", f"[{of('N')}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(name, inner)
    return pattern


class ByteBpe:
    """One vocabulary of ranks: encode() to packed little-endian unsigned 32-bit ids, decode() back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.widest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.fits = Memo(self._fits, 2_000_000, 32 << 20)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        # texts of Latin-1 letters alone can be cut by the standard library, which is faster, with the classes spelled out
        self.latin = re.compile(spelled_out(pattern)).findall if pattern == WORDS else None
        self.packed = Memo(self._piece, 1_000_000, 32 << 20)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern)

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: (self.ranks.get(parts[k] + parts[k + 1], NEVER), k))
                if self.ranks.get(parts[best] + parts[best + 1], NEVER) >= token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            made = len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """From the single byte at a token's left (0) or right (1) edge up to the token: what stands there over time."""
        known = self.edges[side]
        if token not in known:
            pair = self.half(token)
            known[token] = [*self._edge(pair[side], side), token] if pair else [token]
        return known[token]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether no merge across the border comes before the merges that absorb the symbols beside it."""
        left, right = self._edge(pair[0], 1), self._edge(pair[1], 0)
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else NEVER
            next_right = right[j + 1] if j + 1 < len(right) else NEVER
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NEVER)
            if across < next_left and across <= next_right and across < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        fits, known, longest = self.fits, self.ranks.get, self.automaton.longest_prefix
        dead = bytearray(n + 1)
        ids: list[int] = []
        sizes: list[int] = []
        at, size = 0, longest(text)
        while at < n:
            while size:
                rank = known(piece[at : at + size])
                if rank is not None and not dead[at + size] and (not ids or fits[ids[-1], rank]):
                    break
                size -= 1
            if size:
                ids.append(rank)
                sizes.append(size)
                at += size
                size = longest(text[at : at + self.widest])
            elif not ids:
                raise ValueError("the vocabulary lacks a byte of the piece")
            else:
                dead[at] = 1
                ids.pop()
                size = sizes.pop() - 1
                at -= size + 1
        return ids

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern."""
        ids = self.piece_ids(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        find = self.latin if self.latin and LATIN(text) else self.pieces.findall
        return b"".join(map(self.packed.__getitem__, find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    return ByteBpe.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): packed ids of every whole text, and the bytes that they decode to.

    A null or empty text has no ids and decodes to no bytes; repeated rows and null ids stay as they are; extra
    columns are ignored; an empty table gives no rows. The file of the vocabulary must be at `path` on every executor.
    """
    return _coded(docs, path, pattern, {"ids": "binary", "decoded": "binary"})


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents() gives, worked out where it is made; empty tables give no rows."""
    return _coded(docs, path, pattern, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def encode_with_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids), as encode_digests() and encode_documents() have them."""
    return _coded(docs, path, pattern, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "binary"})


def _sha256(values: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())


#: Each column from the packed ids and the decoded bytes of a few documents.
COLUMNS = {
    "n_tokens": lambda ids, decoded: pa.array([len(v) // 4 for v in ids], pa.int64()),
    "ids_sha256": lambda ids, decoded: _sha256(ids),
    "decoded_sha256": lambda ids, decoded: _sha256(decoded),
    "ids": lambda ids, decoded: pa.array(ids, pa.binary()),
    "decoded": lambda ids, decoded: pa.array(decoded, pa.binary()),
}


def _coded(docs: DataFrame, path: str, pattern: str, columns: dict[str, str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for whole in released(batches):
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                ids = [coder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                decoded = [coder.decode(v) for v in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(COLUMNS[c](ids, decoded) for c in columns)], ["doc_id", *columns])

    ship(docs.sparkSession)
    schema = ", ".join(["doc_id long", *(f"{c} {kind}" for c, kind in columns.items())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)

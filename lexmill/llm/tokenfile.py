"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A file is a Parquet table of segments, written by Spark so that it may live in any store. A segment holds
some hundred thousand ids or more of consecutive documents and has the columns part, seq, n_docs, n_tokens and
payload. The payload is little-endian:

    8 bytes   "EFIDS001"
    u32 x 4   documents m, null document ids, bytes of an id (2 or 4), 0
    u64 x 2   ids u, smallest document id as two's complement
    boundary sequence, document-id sequence (see EliasFano.pack)
    ids       u of them

Boundaries are the m ends of the documents within the segment; documents are in ascending order of their
id, nulls first, so their ids are an Elias-Fano sequence as well. Both answer select(i) from a sampled
directory over the upper bits, in about 2 + log2(u / m) bits a document, with no table of 64-bit offsets.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Memo, batches_of, released, save, ship, small

MAGIC = b"EFIDS001"
#: Every so many ones of the upper bits, their place is kept.
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of m numbers below a bound, with select(i) for its i-th number."""

    def __init__(self, m: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.m, self.low_bits, self.low, self.high, self.marks = m, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        m = len(values)
        top = int(values[-1]) if m else 0
        low_bits = max(0, (top // m).bit_length() - 1) if m else 0
        upper = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(m)
        high = np.zeros((int(upper[-1]) + 8) // 8 if m else 0, dtype=np.uint8)
        np.bitwise_or.at(high, upper >> 3, (1 << (upper & 7)).astype(np.uint8))
        lower = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((m, 0))
        low = np.packbits(lower.astype(np.uint8).reshape(-1), bitorder="little")
        return cls(m, low_bits, low, high, upper[::SAMPLE].astype("<u4"))

    def pack(self) -> bytes:
        """u32 m, low bits, bytes of low, bytes of high, marks; then low, high and the marks as u32."""
        head = struct.pack("<5I", self.m, self.low_bits, len(self.low), len(self.high), len(self.marks))
        return head + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        m, low_bits, n_low, n_high, n_marks = struct.unpack_from("<5I", data)
        at = 20
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        marks = np.frombuffer(data, "<u4", n_marks, at + n_low + n_high)
        return cls(m, low_bits, low, high, marks), data[at + n_low + n_high + 4 * n_marks :]

    def _lower(self, first: int, n: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(n, dtype=np.uint64)
        begin, end = first * self.low_bits, (first + n) * self.low_bits
        bits = np.unpackbits(self.low[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :][: end - begin]
        return (bits.reshape(n, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, by a scan from the nearest kept place."""
        if not 0 <= i < self.m:
            raise IndexError(i)
        place, left = int(self.marks[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        upper = (at << 3) + (byte & -byte).bit_length() - 1 - i
        return (upper << self.low_bits) | int(self._lower(i, 1)[0])

    def select_range(self, first: int, n: int) -> np.ndarray:
        """Numbers first to first + n - 1, read from the kept place before the first to the one after the last."""
        if not 0 <= first <= first + n <= self.m:
            raise IndexError((first, n))
        if not n:
            return np.zeros(0, dtype=np.uint64)
        mark, after = first // SAMPLE, (first + n - 1) // SAMPLE + 1
        begin = int(self.marks[mark])
        end = int(self.marks[after]) if after < len(self.marks) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :]
        places = np.flatnonzero(bits)[first - mark * SAMPLE :][:n] + begin
        upper = (places - np.arange(first, first + n)).astype(np.uint64)
        return (upper << np.uint64(self.low_bits)) | self._lower(first, n)


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The payload of documents in ascending order of id, nulls first; ids holds their packed ids."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.uint64)
    head = MAGIC + struct.pack("<4IQq", len(ids), nulls, width, 0, int(ends[-1]) if len(ends) else 0, least)
    return b"".join([head, EliasFano.of(ends).pack(), EliasFano.of((known - least).astype(np.uint64)).pack(), *ids])


class Segment:
    """A payload opened for reading; documents are addressed by their place in it."""

    def __init__(self, payload: bytes):
        view = memoryview(payload)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a segment of token ids")
        self.m, self.nulls, self.width, _, self.u, self.least = struct.unpack_from("<4IQq", view, 8)
        self.ends, rest = EliasFano.unpack(view[40:])
        self.keys, rest = EliasFano.unpack(rest)
        self.ids = np.frombuffer(rest, f"<u{self.width}", self.u)

    def __len__(self) -> int:
        return self.m

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[slice(*self.span(i))]

    def doc_ids(self, first: int, n: int) -> list[int | None]:
        nulls = min(max(self.nulls - first, 0), n)
        return [None] * nulls + (self.keys.select_range(first + nulls - self.nulls, n - nulls).astype(np.int64) + self.least).tolist()

    def spans(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of documents first to first + n - 1."""
        ends = self.ends.select_range(first, n).astype(np.int64)
        return np.concatenate([[self.ends.select(first - 1) if first else 0], ends[:-1]]).astype(np.int64), ends


#: Letters, numbers and others among the printable characters of Latin-1, where case and composition are plain.
PLAIN = "".join(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)] if c != 0xAD)


class WordBpe:
    """Ids by the tokenizers library; words and pieces seen before are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.letters = False
        self.words = Memo(self._word, 1_000_000, 96 << 20)
        self.pieces = Memo(self._piece, 1_000_000, 128 << 20)
        of = lambda kind: "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{of('L')}{of('N')}]+")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{of('L')}{of('N')} \n]+").findall
        self.special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.lead = re.compile("|".join(sorted({re.escape(s[0]) for s in self.special if s}))) if self.special else re.compile("(?!)")
        # how the library's byte level writes bytes as characters: printable ones as themselves, the rest from 256 on
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        self.letter = {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}
        self.plain = self._is_plain()
        # ASCII letters alone are one piece and hold no special token, unless one is of such letters itself
        self.letters = self.plain and not any(s.isalpha() for s in self.special)

    def _is_plain(self) -> bool:
        """Whether the short cut over pieces agrees with the library on a probe of all plain characters."""
        probe = [*PLAIN, "Don't", "naïve", "1½x", "A.b,c", PLAIN, PLAIN[::-1], *(f"a{c}b" for c in PLAIN)]
        return all(self._short(w) == self._whole(w) for w in probe)

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode("utf-8")))
        return self._packed([t.id for t in self.model.tokenize(written)])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _short(self, word: str) -> bytes:
        low = word.lower()
        return self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.split.findall(low)))

    def _whole(self, word: str) -> bytes:
        return self._packed(self.library.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if self.letters and word.isascii() and word.isalpha():
            return self.pieces[word.lower()]
        plain = self.plain and ALL_PLAIN(word) and not (self.lead.search(word) and any(s in word for s in self.special))
        return self._short(word) if plain else self._whole(word)

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; words between spaces and line ends are encoded apart, as the library does.

        A text of plain characters alone is cut into pieces at once, any other word by word.
        """
        if self.plain and PLAIN_TEXT(text) and not (self.lead.search(text) and any(s in text for s in self.special)):
            return b"".join(map(self.pieces.__getitem__, self.cut(text.lower())))
        return b"".join(map(self.words.__getitem__, WORDS.split(text)))


ALL_PLAIN = re.compile(f"[{re.escape(PLAIN)}]*").fullmatch
PLAIN_TEXT = re.compile(f"[{re.escape(PLAIN)} \n]*").fullmatch
#: Words are what spaces and line ends leave.
WORDS = re.compile("[ \n]+")


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One coder for each worker process."""
    return WordBpe(path)


def write_token_file(docs: DataFrame, path: str, end_id: int = 2, segment_ids: int = 1_000_000, out: str | None = None) -> DataFrame:
    """Encode every whole text, append end_id, and write segments in ascending order of doc_id; returns the file's table.

    path: the tokenizer, on every executor; out: where the file goes, a scratch table if it is None. Texts are encoded
    where they are read, and their packed ids are written once; only ids move. Documents are dealt by ranges of (doc_id,
    hash of the text), so that a doc_id on many rows is spread; rows with equal ids are in order of that hash and of
    their token ids. A null text counts as empty and has the end id alone; repeated rows stay; extra columns are
    ignored; an empty table gives a file without segments.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        end = np.array([end_id], dtype=f"<u{coder.width}").tobytes()
        for whole in released(batches):
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids = [(coder.encode(t) if t else b"") + end for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([coder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "tie", "width", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = seq = part = 0
        width = 2

        def segment():
            row = [[part], [seq], [len(keys)], [size // width], [pack_segment(keys, ids, width)]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, width, packed, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007 (segment() reads them)
                keys.append(doc_id)
                ids.append(packed)
                size += len(packed)
                if size >= segment_ids * width:
                    yield segment()
                    keys, ids, size, seq = [], [], 0, seq + 1
        if keys:
            yield segment()

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    with batches_of(docs.sparkSession, 2000):
        coded = save(rows.mapInArrow(encode, "doc_id long, tie long, width int, ids binary"), "ids", "zstd")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("doc_id", "width", "ids", F.spark_partition_id().alias("part"))
    file = dealt.mapInArrow(pack, "part int, seq int, n_docs int, n_tokens long, payload binary")
    with batches_of(docs.sparkSession, 2000):
        if out is None:
            return save(file, "token_ids")
        file.write.parquet(out)
    return open_documents(docs.sparkSession, out)


def segment_starts(file: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each segment. Prefix sums within a part and over the parts' totals."""
    heads = file.select("part", "seq", "n_tokens")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part of the file, of which there are as many as shuffle partitions
    totals = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("part_base"))
    inner = heads.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before("part")), F.lit(0)).alias("inner_base"))
    return inner.join(F.broadcast(parts), "part").select("part", "seq", (F.col("part_base") + F.col("inner_base")).alias("base"))


#: Documents of a segment that are read at once.
AT_ONCE = 4096


def read_token_file(file: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file, read from its segments.

    Where a document begins and ends comes from the select structure over the boundaries, some thousand documents at a
    time. start counts the ids of all documents before; the checksum is over the ids as little-endian unsigned 32-bit
    integers. Null and repeated document ids come back as they were written; a file without segments gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seg = Segment(batch.column(2)[k].as_py())
                for first in range(0, len(seg), AT_ONCE):
                    n = min(AT_ONCE, len(seg) - first)
                    begins, ends = seg.spans(first, n)
                    crc = [zlib.crc32(seg.ids[b:e].astype("<u4")) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                    same = lambda c: pa.array([batch.column(c)[k].as_py()] * n, pa.int32())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [same(0), same(1), pa.array(seg.doc_ids(first, n), pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                        ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    ship(file.sparkSession)
    rows = file.select("part", "seq", "payload").mapInArrow(work, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    starts = segment_starts(file)
    return rows.join(small(starts, file.count()), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def open_documents(spark: SparkSession, path: str) -> DataFrame:
    """A token-id file that lies at a path."""
    return spark.read.schema("part int, seq int, n_docs int, n_tokens long, payload binary").parquet(path)

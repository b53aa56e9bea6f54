"""Token counts under a sentencepiece BPE model by heap-and-linked-list merging.

A word's characters form a doubly linked list; a heap holds the adjacent pairs that are pieces, lowest rank
first. Each pop of a pair that still stands merges it and pushes the pairs that the merge made. The count is the
number of symbols at the start less the merges; a symbol that is no piece counts its UTF-8 bytes (byte fallback).
No ids are made. A piece never holds a space mark after another character, so the words of a text merge apart
from each other, and a worker remembers the counts of words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Memo, released, ship

MARK = "▁"


class PieceCounter:
    """Counts tokens as the model's library does: identity normalisation, a space mark in front, byte fallback."""

    def __init__(self, ranks: dict[str, int]):
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("pieces that hold a space mark inside are not supported")
        self.ranks = ranks
        self.letters = {p for p in ranks if len(p) == 1}
        self.words = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.counts = Memo(self.word_tokens, 1_000_000, 128 << 20)

    @classmethod
    def from_model(cls, path: str) -> PieceCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        normal = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # equal scores share a rank; the pair further left then goes first
        places = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        return cls({model.id_to_piece(i): places[model.get_score(i)] for i in normal})

    def word_tokens(self, word: str) -> int:
        rank_of, n = self.ranks.get, len(word)
        symbols: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a heap entry is one integer: rank, place of the left symbol, joined length
        bits = n.bit_length() + 1
        mask, push = (1 << bits) - 1, heapq.heappush
        heap = [((rank << bits | k) << bits) | 2 for k in range(n - 1) if (rank := rank_of(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        left_over = n
        while heap:
            entry = heapq.heappop(heap)
            left, size = entry >> bits & mask, entry & mask
            symbol = symbols[left]
            if symbol is None or (right := after[left]) == n or len(joined := symbol + symbols[right]) != size:
                continue
            symbols[left], symbols[right] = joined, None
            left_over -= 1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                made = joined + symbols[follow]
                if (rank := rank_of(made)) is not None:
                    push(heap, ((rank << bits | left) << bits) | len(made))
            lead = before[left]
            if lead >= 0:
                made = symbols[lead] + joined
                if (rank := rank_of(made)) is not None:
                    push(heap, ((rank << bits | lead) << bits) | len(made))
        if not self.letters.issuperset(word):
            left_over += sum(len(s.encode("utf-8")) - 1 for s in symbols if s is not None and len(s) == 1 and s not in self.letters)
        return left_over

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.words.findall(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceCounter:
    """One counter for each worker process."""
    return PieceCounter.from_model(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    A null or empty text has no bytes and no tokens; repeated rows and null ids stay as they are; extra columns
    are ignored; an empty table gives no rows. The model must be at `path` on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in released(batches):
            n = [counter.count(batch.column(2)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

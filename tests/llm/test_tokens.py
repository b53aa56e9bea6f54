import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from lexmill.llm import bytebpe, piececount, tokenfile
from tests.llm.conftest import AWKWARD, documents

ODD = "aabbcdthe  \n\t'sS<s>éÉ日İ \x1c\x85\xa0 12३½.,<|>ßﬁ①▁̀🙂\x00"


def odd_texts(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 900, "ab" * 400, " " * 300 + "x", "\n" * 99, "thetionerin" * 80, "<|endoftext|> </s> <unk>"]


def test_byte_bpe_gives_the_librarys_ids():
    coder = bytebpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text in odd_texts():
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
        assert coder.decode(packed) == text.encode()


def test_latin_texts_are_cut_like_any_other():
    rng = random.Random(9)
    coder = bytebpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert coder.latin is not None
    words = tokenfile.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(3000):
        letters = [chr(rng.randrange(256)) if rng.random() < 0.5 else rng.choice(" \n'sdabeé1½ªº") for _ in range(rng.randint(0, 30))]
        text = "".join(letters)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert np.frombuffer(words.encode(text), f"<u{words.width}").tolist() == other.encode(text, add_special_tokens=False).ids


def test_byte_bpe_over_rows(awkward, nothing):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bytebpe.encode_digests(awkward, *args).collect()
    assert len(rows) == len(AWKWARD)
    by_text = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in AWKWARD}
    assert {r.decoded_sha256 for r in rows} == by_text
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert bytebpe.encode_documents(nothing, *args).collect() == []


def test_piece_counts_are_the_librarys():
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, reference = piececount.PieceCounter.from_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in odd_texts():
        assert counter.count(text) == len(reference.encode(text))


def test_piece_counts_over_rows(awkward, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in piececount.count_tokens(awkward, path).collect()}
    assert rows[3].n_tokens == rows[3].n_bytes == 0 and rows[7].over_limit and not rows[1].over_limit
    assert rows[9].n_bytes == len(AWKWARD[-1][1].encode())
    assert piececount.count_tokens(nothing, path).collect() == []


@pytest.mark.parametrize("m", [0, 1, 2, 63, 64, 65, 400])
def test_elias_fano_selects_every_number(m):
    rng = np.random.default_rng(m)
    for bound in (1, 3, 1000, 10**12):
        values = np.sort(rng.integers(0, bound, m).astype(np.uint64))
        read, rest = tokenfile.EliasFano.unpack(memoryview(tokenfile.EliasFano.of(values).pack()))
        assert not len(rest)
        assert read.select_range(0, m).tolist() == values.tolist() == [read.select(i) for i in range(m)]


def test_word_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, reference = tokenfile.WordBpe(path), Tokenizer.from_file(path)
    for text in odd_texts():
        assert np.frombuffer(coder.encode(text), f"<u{coder.width}").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip(spark, awkward, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    file = tokenfile.write_token_file(awkward, path, segment_ids=50)
    assert file.count() > 1
    rows = sorted(tokenfile.read_token_file(file).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, *_ in AWKWARD), key=lambda d: -1 if d is None else d)
    texts = {d: t for d, t, *_ in AWKWARD}
    at = 0
    for r in rows:
        ids = [*reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = tokenfile.Segment(bytes(file.where("n_docs > 1").first().payload))
    assert [one.doc_id(i) for i in range(len(one))] == one.doc_ids(0, len(one))
    assert sum(len(one.document(i)) for i in range(len(one))) == one.u
    assert tokenfile.read_token_file(tokenfile.write_token_file(nothing, path)).collect() == []


def test_queries_take_columns_of_any_name(spark, tmp_path):
    """Columns that clash with the operators' own, and empty tables, through the queries themselves."""
    from lexmill.llm import catalog

    names = ("ids", "tie", "width", "part", "fp", "t1", "root", "n_tokens", "n_bytes", "held_out", "lang_pred", "score", "_u", "shard", "slot", "size", "copies", "rule", "_k1", "v", "h1", "rep")
    for kind, rows in (("some", AWKWARD), ("none", [])):
        folder = f"{tmp_path}/{kind}"
        documents(spark, rows, names).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        vectors = [(k, [1.0, 0.01 * k], 1, "x", "x", "x") for k in range(9)] if rows else []
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, v string, h1 string, rep string").write.parquet(f"{folder}/embeddings.parquet")
        for name, query in catalog.queries().items():
            found = query(spark, folder).collect()
            if name != "pipeline":
                assert len(found) == (len(vectors) if name.startswith("op7") else len(rows)), name
                assert found or kind == "none"


def test_a_token_file_at_a_path(spark, awkward, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write_token_file(awkward, path, out=f"{tmp_path}/file")
    again = tokenfile.read_token_file(tokenfile.open_documents(spark, f"{tmp_path}/file"))
    scratch = tokenfile.read_token_file(tokenfile.write_token_file(awkward, path))
    assert sorted(map(str, again.collect())) == sorted(map(str, scratch.collect()))


def test_select_reads_ranges():
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 50_000, 1000).astype(np.uint64))
    sequence = tokenfile.EliasFano.of(values)
    for first, n in ((0, 0), (0, 1), (63, 2), (64, 64), (500, 137), (999, 1), (0, 1000)):
        assert sequence.select_range(first, n).tolist() == values[first : first + n].tolist()
    with pytest.raises(IndexError):
        sequence.select_range(990, 11)


def test_other_patterns_go_piece_by_piece():
    ranks = bytebpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    for pattern in (r"\S+|\s+", r"\p{L}{1,3}|[^\p{L}]"):
        coder = bytebpe.ByteBpe(ranks, pattern)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for text in odd_texts(200):
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)

"""The encoders, token files and packing against the library on whole texts."""

import bisect
import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import same
from virocohort.llm import bpe, packing, token_files
from virocohort.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    t = Tokenizer.from_file(path) if path not in ids_of.__dict__ else ids_of.__dict__[path]
    ids_of.__dict__[path] = t
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(odd_rows):
    r = random.Random(1)
    pieces = ["É", "ß", "İ", "ǅ", ",", ";", " ", "  ", "\n", "\t", "a", "B", "é", "e\u0301", "1", ".", "'s", "<|endoftext|>", "\u00a0", "\x1f", "\u3000", "日", "Σ", "\x0b", "\u200b", "ﬁ", "😀", "word", "Two,"]
    odd = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(4000)]
    own = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    return odd + own + [t or "" for _, t in odd_rows] + ["", " ", "\n", "x" * 5000]


@pytest.mark.parametrize(("path", "split"), [(BYTE, "spaced"), (WORD, "words"), (BYTE, None)])
def test_units_give_the_ids_of_the_whole_text(texts, path, split):
    encode = Encoder(path, split, cache_units=5000)
    for t in texts if split else texts[:300]:
        assert list(array("I", encode(t.encode()))) == ids_of(path, t), t[:80]
    assert encode(None) == b""


def test_trie_gives_the_ids_and_names_of_the_library(texts):
    codec = bpe.Codec(WORD, cache_units=5000)
    library = Tokenizer.from_file(WORD)
    for t, ids in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        numbers = list(array("I", ids))
        assert numbers == ids_of(WORD, t), t[:80]
        assert codec.decode(ids).decode() == library.decode(numbers, skip_special_tokens=False)


def test_trie_on_words_with_many_equal_merges():
    r = random.Random(5)
    words = ["".join(r.choice("aabeehnorst") for _ in range(r.randint(1, 14))) for _ in range(5000)] + [c * k for c in ("a", "ab", ".", "ha") for k in range(1, 40)]
    codec = bpe.Codec(WORD)
    assert [list(array("I", i)) for i in codec.encode([w.encode() for w in words])] == [ids_of(WORD, w) for w in words]


def test_trie_takes_words_of_a_million_letters():
    r = random.Random(9)
    words = ["".join(r.choices("acgt", k=1_000_000)), "x" * 1_000_000]
    codec, library = bpe.Codec(WORD), Tokenizer.from_file(WORD)
    for word, ids in zip(words, codec.encode([w.encode() for w in words]), strict=True):
        assert array("I", ids).tolist() == library.encode(word, add_special_tokens=False).ids


def test_encode_and_decode_documents(odd_documents, odd_rows, no_documents):
    encoded = bpe.encode_documents(odd_documents, WORD)
    same([(r.doc_id, bytes(r.ids)) for r in encoded.collect()], [(i, np.array(ids_of(WORD, t), "<u4").tobytes()) for i, t in odd_rows])
    library = Tokenizer.from_file(WORD)
    names = [(i, library.decode(ids_of(WORD, t), skip_special_tokens=False)) for i, t in odd_rows]
    same(bpe.decode_documents(encoded, WORD).collect(), names)
    want = [(i, len(ids_of(WORD, t)), hashlib.sha256(np.array(ids_of(WORD, t), "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, t), (_, d) in zip(odd_rows, names, strict=True)]
    same(bpe.digest_documents(odd_documents, WORD).collect(), want)
    assert bpe.digest_documents(no_documents, WORD).collect() == []


def test_token_files(spark, tmp_path, odd_documents, odd_rows, no_documents):
    token_files.write_ids(odd_documents, f"{tmp_path}/t", BYTE, "spaced", 0, 50257, shard_bytes=60_000)
    got = token_files.read_ids(spark, f"{tmp_path}/t").orderBy("start").collect()
    ids = {(i, t): [*ids_of(BYTE, t), 0] for i, t in odd_rows}
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    same([(r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got],
         [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), np.array(x, "<u4").tobytes()) for (i, t) in odd_rows for x in [ids[i, t]]])
    assert len(list((tmp_path / "t").glob("shard-*.ids"))) > 1 and len(list((tmp_path / "t").glob("*.zdict"))) == 1
    for doc in (56, 0, 51):
        assert [x.tolist() for x in token_files.read_document(spark, f"{tmp_path}/t", doc)] == [ids[i, t] for i, t in odd_rows if i == doc]
    assert len(token_files.read_document(spark, f"{tmp_path}/t", 3)) == 3 and token_files.read_document(spark, f"{tmp_path}/t", 999) == []
    assert token_files.round_trip(spark, no_documents, BYTE, "spaced", 0, 50257, f"{tmp_path}/none").collect() == []


def test_token_files_share_a_dictionary(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    token_files.write_ids(docs, f"{tmp_path}/t", BYTE, "spaced", 0, 50257)
    (name,) = (tmp_path / "t").glob("*.zdict")
    assert name.stem == hashlib.sha256(name.read_bytes()).hexdigest() and name.stat().st_size > 1000
    name.write_bytes(name.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="hash"):
        token_files.read_ids(spark, f"{tmp_path}/t").count()


def test_packing(spark, odd_documents, odd_rows, no_documents):
    docs = odd_documents
    pieces = packing.cut_pieces(docs, WORD, "words", ids=True)
    placed = packing.pack(pieces, packer_pieces=20).cache()
    got = placed.collect()
    want = []
    for i, t in odd_rows:
        ids = np.array([*ids_of(WORD, t), 0], "<u4")
        want += [(i, k, 2048 * k, len(ids[2048 * k:2048 * k + 2048]), zlib.crc32(ids[2048 * k:2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in by.values():
        parts.sort()
        assert [o for o, _, _ in parts] == list(np.cumsum([0, *(n for _, n, _ in parts)])[:-1]) and sum(n for _, n, _ in parts) <= 2048
    same([(r.sequence_id, r.pieces, bytes(r.ids)) for r in packing.sequences(placed).collect()], [(s, len(p), b"".join(x for _, _, x in p)) for s, p in by.items()])
    assert packing.pack_documents(no_documents, WORD, "words").collect() == []
    r = packing.fill(placed).first()
    assert r.sequences == len(by) and r.least <= r.sequences


def test_packing_is_close_to_the_least():
    r = np.random.default_rng(4)
    lengths = np.concatenate([np.full(3000, 2048), r.integers(1, 2049, 12_000)])
    bins, offsets, levels = packing.pack_lengths(lengths, 2048, 3, 0.95)
    assert np.bincount(bins, lengths).max() == 2048
    gaps, best_fit = [], 0  # best fit from the longest down
    for n in sorted(lengths.tolist(), reverse=True):
        i = bisect.bisect_left(gaps, n)
        gap = 2048 if i == len(gaps) else gaps.pop(i)
        best_fit += gap == 2048
        if gap > n:
            bisect.insort(gaps, gap - n)
    assert len(np.unique(bins)) <= 1.008 * best_fit
    assert (levels == np.bincount(bins, lengths)[bins]).all()


def test_sum_of_squares_takes_the_best_place():
    """Each step leaves the least sum of squared counts that any place would."""
    size, r = 12, random.Random(3)
    lengths = [r.randint(1, size) for _ in range(300)]
    bins, offsets, _ = packing.sum_of_squares(np.array(lengths), size)
    level = {}
    cost = lambda lv: sum(c * c for g, c in zip(*np.unique([size - v for v in lv.values()], return_counts=True)) if g)
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        choices = [cost({**level, x: v + n}) for x, v in level.items() if v + n <= size] + [cost({**level, "new": n})]
        assert level.get(b, 0) == o
        level[b] = o + n
        assert cost(level) == min(choices)

"""BPE encoding by a prefix-sharing trie, and decoding.

The encoding of a prefix of a word ends in one certain token: of the tokens that end there, the only one that stands
unmerged beside the last token of what precedes it.  So a word's encoding follows from one state per prefix, its last
token, and words with a common prefix share these states.  The distinct new words of some megabytes of text are
put into a trie, here their sorted list, whose neighbours' common prefixes are the trie's inner nodes; a
depth-first walk keeps the states of the current path, so that every prefix is worked out once.

Whether two tokens stay apart depends on the parts along their touching edges: a merge of two such parts must not come
up while both exist.  Answers are remembered per pair.

Vocabulary, merges, added tokens, normaliser and pre-tokeniser come from a tokenizer file with word ends; the model's
own merging isn't used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virocohort.llm.tokens import ALPHABET, LETTERS

NEVER = 1 << 40
MARKS = b".,;:!?"
SPECIAL = b"\xff"  # in no UTF-8 text; begins the key of an added token


class TrieBpe:
    """Encodes words (strings of byte-level characters, without the end mark) to ids."""

    def __init__(self, model: dict):
        end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        born = self.born = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            made = vocab[left + right]
            self.rank.setdefault((vocab[left], vocab[right]), r)
            if made not in self.parts:
                self.parts[made], born[made] = (vocab[left], vocab[right]), r
        self.apart: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            if self._whole(i):
                ends = bool(end) and token.endswith(end) and token != end
                (self.final if ends or not end else self.inner)[token.removesuffix(end) if ends else token] = i
                if not end:
                    self.inner[token] = i
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)

    def _whole(self, i: int) -> bool:
        """Whether merging a token's own text gives the token back."""
        return i not in self.parts or self._whole(self.parts[i][0]) and self._whole(self.parts[i][1]) and self._beside(*self.parts[i], self.born[i])

    def _edge(self, i: int, side: int) -> list[tuple[int, int, int]]:
        """The parts along a token's left (0) or right (1) edge: part, when it is made, when it is merged further."""
        if i not in self.edges[side]:
            found, part, until = [], i, NEVER
            while True:
                found.append((part, self.born.get(part, -1), until))
                if part not in self.parts:
                    break
                part, until = self.parts[part][side], self.born[part]
            self.edges[side][i] = found
        return self.edges[side][i]

    def _beside(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether no merge over the seam comes up before the given one.  Of equal merges the leftmost comes first: one
        within the left token precedes one over the seam, and that precedes one within the right token."""
        for a, a_from, a_to in self._edge(left, 1):
            for b, b_from, b_to in self._edge(right, 0):
                r = self.rank.get((a, b), NEVER)
                if a_from < r < a_to and b_from < r <= b_to and r < before:
                    return False
        return True

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, 32-bit little-endian."""
        inner, final, apart, code = self.inner, self.final, self.apart, {}
        last, back = [-1], [0]  # of the prefixes on the current path, by length: last token, where it begins
        before, found = "", {}
        for word in sorted(words):
            n, same = len(word), 0
            for x, y in zip(word, before):  # noqa: B905  up to the shorter
                if x != y:
                    break
                same += 1
            before = word
            del last[min(same, n - 1) + 1:], back[min(same, n - 1) + 1:]
            for at in range(len(last), n + 1):
                tokens = final if at == n else inner
                for k in range(at - 1, max(-1, at - self.longest - 1), -1):
                    t = tokens.get(word[k:at])
                    if t is None or last[k] is None:
                        continue
                    pair = (last[k], t)
                    fits = apart.get(pair)
                    if fits is None:
                        fits = apart[pair] = k == 0 or self._beside(*pair)
                    if fits:
                        part = code.get(t) or code.setdefault(t, t.to_bytes(4, "little"))
                        break
                else:
                    raise ValueError(f"no token ends {word[:at]!r}: the vocabulary lacks a byte")
                if at == n:
                    parts = [part]
                    while k:
                        parts.append(code[last[k]])
                        k = back[k]
                    found[word] = b"".join(reversed(parts))
                else:
                    last.append(t)
                    back.append(k)
        return found


class Codec:
    """Encodes and decodes texts as the file's tokenizer does, without adding special tokens."""

    def __init__(self, path: str, cache_units: int = 600_000, unit_bytes: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.bpe = TrieBpe(described["model"])
        self.added = {t["content"].encode(): t["id"] for t in described["added_tokens"]}
        self.any_added = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        names = {i: t for t, i in described["model"]["vocab"].items()} | {i: t.decode() for t, i in self.added.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.cache_units, self.unit_bytes, self.cache = cache_units, unit_bytes, {}

    def units(self, text: bytes) -> list[bytes]:
        """What stands between ASCII blanks, in ASCII lower case (the tokenizer drops blanks and lowers all letters)."""
        if self.any_added is None or not any(t in text for t in self.added):
            return text.lower().split()
        found = []
        for k, part in enumerate(self.any_added.split(text)):
            found += [SPECIAL + part] if k % 2 else part.lower().split()
        return found

    def words(self, unit: bytes) -> list[str]:
        if len(unit) > 1 and unit[-1] in MARKS and unit[-2:-1].isalpha():  # such a mark is a word of its own
            return self.words(unit[:-1]) + [chr(unit[-1])]
        text = unit.decode("utf-8", "replace")
        if LETTERS.fullmatch(text):
            return [text if text.isascii() else text.lower().encode().decode("latin-1").translate(ALPHABET)]
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _learn(self, units: set[bytes]) -> dict[bytes, bytes]:
        cut = {u: self.words(u) for u in units if u[:1] != SPECIAL}
        ids = self.bpe.encode(list({w for words in cut.values() for w in words}))
        found = {u: b"".join([ids[w] for w in words]) for u, words in cut.items()}
        return found | {u: self.added[u[1:]].to_bytes(4, "little") for u in units if u[:1] == SPECIAL}

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        i = 0
        while i < len(texts):  # some megabytes at a time share a trie
            some, size = [], 0
            while i < len(texts) and size < 4 << 20:
                some.append(self.units(texts[i] or b""))
                size += len(texts[i] or b"")
                i += 1
            if len(self.cache) > self.cache_units:
                self.cache.clear()
            new = set().union(*some) - self.cache.keys()
            learnt = self._learn(new)
            self.cache.update(learnt)
            for units in some:
                yield b"".join(map(self.cache.__getitem__, units))
            for u in new:
                if len(u) > self.unit_bytes:
                    del self.cache[u]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' names with spaces between, as the library gives them for a file without a decoder."""
        return b" ".join(map(self.names.__getitem__, array("I", ids)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (32-bit little-endian).

    Null and empty texts have no ids; null and repeated ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(codec(path).encode(batch.column("text").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, decoded (the tokens' names with spaces between; null ids decode to nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for ids in coder.encode(batch.column("text").cast(pa.binary()).to_pylist()):
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

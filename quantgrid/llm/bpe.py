"""Exact byte-pair encoding by dynamic programming over prefixes.

Every prefix of a pre-token has one encoding, so one last token. An automaton over the vocabulary
gives the tokens that end at each position; the longest that is compatible with the last token of
what lies before it is the last token of the prefix, and back-pointers from the end give the ids. Two
tokens are compatible when merging would never join a piece of the one with a piece of the other.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quantgrid.llm.common import documents, fields
from quantgrid.llm.tokens import BYTE_LETTERS, PRETOKENS, Chunks, byte_chunks, vocabulary


class Codec:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        letters = {c: b for b, c in enumerate(BYTE_LETTERS)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.rank, self.halves, self.joined = {}, {}, {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            token = vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
            self.joined[left, right] = rank
            self.rank.setdefault(token, rank)
            self.halves.setdefault(token, (left, right))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.halves or len(token) == 1:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.words = regex.compile(PRETOKENS).findall
        self.fits = lru_cache(1 << 18)(self.compatible)
        self.word = Chunks(self.tokens)
        self.head = Chunks(lambda chunk: self.described(chunk))
        self.tail = Chunks(lambda chunk: self.described(" " + chunk))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        Undo the merges inside both, the last first, and see what touches at the border: had the
        touching pieces a merge that comes before the one which used up either of them, it would have been made.
        """
        never = len(self.joined)
        end_left = end_right = never
        while True:
            rank = self.joined.get((left, right), never)
            if rank < end_left and rank <= end_right and rank < never:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, end_left = self.halves[left][1], made_left
            else:
                right, end_right = self.halves[right][0], made_right

    def tokens(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        letters = "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
        n = len(letters)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for at, (length, token) in self.automaton.iter(letters):  # at each end, the longest first
            end = at + 1
            if last[end] < 0 and (length == end or last[end - length] >= 0 and self.fits(last[end - length], token)):
                last[end], size[end] = token, length
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def described(self, text: str) -> tuple[tuple[int, ...], bytes, bytes]:
        """Ids of a text without special tokens, the ids in decimal with a comma after each, and the bytes that they stand for."""
        if text[-1:] in (".", ",") and text.strip(" ")[:-1].isalpha():
            ids = self.word[text[:-1]] + self.word[text[-1]]
        else:
            ids = tuple(i for word in self.words(text) for i in self.word[word])
        return ids, b"".join(b"%d," % i for i in ids), b"".join(map(self.bytes_of.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[tuple[int, ...], bytes, bytes]]:
        """The text in pieces, each as ``described``."""
        if self.at_special and self.at_special.search(text):
            out = []
            for piece in self.at_special.split(text):
                if piece in self.special:
                    i = self.special[piece]
                    out.append(((i,), b"%d," % i, self.bytes_of[i]))
                elif piece:
                    out += self.parts(piece)
            return out
        chunks = byte_chunks(text)
        if chunks is None:
            return [self.described(text)]
        return [self.head[chunks[0]], *map(self.tail.__getitem__, chunks[1:])]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _, _ in self.parts(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that they decode to; null and empty texts have no ids, rows that repeat stay."""

    def run(batches):
        for batch in batches:
            ids = [codec(path).encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec(path).decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return fields(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` as digests: n_tokens, sha256 of the ids in decimal with commas and of the decoded text."""

    def run(batches):
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                parts = codec(path).parts(text)
                n.append(sum(len(p[0]) for p in parts))
                ids_sha.append(hashlib.sha256(b"".join([p[1] for p in parts])[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return fields(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))

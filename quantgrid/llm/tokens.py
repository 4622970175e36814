"""Token ids of whole texts through the tokenizers library.

A text is cut where the tokenizer's own pre-tokenisation is sure to cut too, and the ids of a chunk are remembered,
up to ``MEMORY`` chunks a worker. Texts in which a cut could change the ids go to the library whole. Many texts at a
time are cut into pre-tokens as one array of bytes, and the library's model gets those that are new in one string.
Chunks between spaces that have other than Latin characters go to the whole library there.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by one Python worker, and the longest one that is.
MEMORY = 400_000
LONGEST = 48

#: Bytes of text whose chunks are told apart at a time.
SLICE = 1 << 25

#: Pre-tokens that the library's model gets at a time.
JOINED = 1000

#: A space between two white spaces, or a last one after a white space, is no safe cut.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")

#: How the two kinds of tokenizers split a text, and the letters that stand for bytes.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_LETTERS = [chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256)]

#: Up to here characters are letters in any Unicode version, and in composed form.
LATIN_END = "\u0250"

#: Kinds of bytes: letter, digit, other, white space, space, and one that needs the library. Bytes from 0x80 on are parts of Latin letters
#: after a lead byte of 0xC3 to 0xC9; the second table has the characters after 0xC2 and 0xC3, whose white spaces need the library.
_LETTER, _DIGIT, _OTHER, _WHITE, _SPACE, _ODD = range(6)


def _kind(char: str) -> int:
    if char in " \t\n\v\f\r":
        return _SPACE if char == " " else _WHITE
    if char.isspace():
        return _ODD
    return _LETTER if char.isalpha() else _DIGIT if unicodedata.category(char)[0] == "N" else _OTHER


_KINDS = bytes(_kind(chr(b)) if b < 0x80 else _ODD if b >= 0xCA else _LETTER for b in range(256))
_KINDS_LATIN = np.array([_kind(chr(c)) for c in range(0x80, 0x100)], np.uint8)
#: Code points of the letters that stand for bytes; 0xFF is in no text and becomes a space.
_POINTS = np.array([*map(ord, BYTE_LETTERS[:255]), 32], "<u4")

_LOADED: dict[str, Encoder] = {}


class Chunks(dict):
    """Bounded memory of a function of short strings, in two generations; long ones are worked out each time."""

    def __init__(self, fn) -> None:
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        return self.keep(chunk, self.fn(chunk) if value is None else value)

    def keep(self, chunk: str, value):
        if len(chunk) <= LONGEST:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def keep_all(self, pairs) -> None:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self.update(x for x in pairs if len(x[0]) <= LONGEST)


def _pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of texts that lie one after another, and those at which a chunk for the library starts.

    A pre-token is a run of one kind with the space before it. The last of several white spaces stands alone, or is that space.
    A text that has to stay whole is one chunk, and so is what lies between spaces and has an odd byte.
    """
    n = len(data)
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8).copy()
    at = np.flatnonzero((data & 0xFE) == 0xC2)
    kind[at] = kind[at + 1] = _KINDS_LATIN[data[at + 1] - 0x80 + 0x40 * (data[at] & 1)]
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    opens[n] = True
    space = kind == _SPACE
    kind[space] = _WHITE
    white = kind == _WHITE
    start = opens.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last white space before something else.
    last = white[:-1] & ~white[1:] & ~opens[1:n]
    start[: n - 1] |= last
    start[1:n] &= ~(last & space[:-1])
    quote = np.flatnonzero((data == 0x27) & start[:n])
    if len(quote):
        following = np.append(data, np.zeros(2, np.uint8))
        one, two = following[quote + 1], following[quote + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        short &= ~opens[np.minimum(quote + 1, n)]
        long &= ~opens[np.minimum(quote + 1, n)] & ~opens[np.minimum(quote + 2, n)]
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    # Texts and chunks for the library.
    mark = np.flatnonzero(data[:-1] == 0x3C)
    whole = np.searchsorted(bounds, mark[data[mark + 1] == 0x7C], "right") - 1
    odd = np.flatnonzero(kind == _ODD)
    low = high = np.empty(0, np.int64)
    if len(odd):
        held = np.unique(np.searchsorted(bounds, odd, "right") - 1)
        whole = np.append(whole, [i for i in held.tolist() if stays_whole(data[bounds[i] : bounds[i + 1]].tobytes().decode())])
        cuts = np.flatnonzero(np.append(data == 0x20, True) | opens)
        chunk = np.unique(np.searchsorted(cuts, odd, "right"))
        low, high = cuts[chunk - 1], cuts[chunk]
    whole = np.unique(whole).astype(np.int64)
    if len(whole):
        free = ~np.isin(np.searchsorted(bounds, low, "right") - 1, whole)
        low, high = np.append(low[free], bounds[whole]), np.append(high[free], bounds[whole + 1])
    if len(low):
        inside = np.zeros(n + 1, np.int8)
        inside[low] += 1
        inside[high] -= 1
        start &= np.cumsum(inside, dtype=np.int8) == 0
        start[low] = start[high] = True
    return np.flatnonzero(start[:n]), low


def stays_whole(text: str) -> bool:
    return "<|" in text or _UNSAFE.search(text) is not None


def byte_chunks(text: str) -> list[str] | None:
    """The first chunk and those that follow a space, or None if the text has to stay whole."""
    return None if stays_whole(text) else text.split(" ")


class Encoder:
    """``ids(text)`` is what the library gives with add_special_tokens=False, as little-endian uint32 bytes.

    Chunks of Latin letters and ASCII go to the library's model word by word; any other chunk goes
    through the whole library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_word = not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        self.words = regex.compile(WORDS if self.by_word else PRETOKENS).findall
        if not self.by_word:
            self.model_only = Tokenizer(self.model)
            self.model_only.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocab = self.tokenizer.get_vocab()
            self.n_bytes = np.zeros(1 + max(vocab.values()), np.int64)
            self.n_bytes[list(vocab.values())] = list(map(len, vocab))
            self.seen, self.odd = Chunks(None), Chunks(lambda chunk: self.whole(chunk))
        self.word = Chunks(self.merge)
        self.head = Chunks(lambda chunk: self.chunk(chunk, ""))
        self.tail = Chunks(lambda chunk: self.chunk(chunk, " "))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token."""
        return array("I", [t.id for t in self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, word.encode())))]).tobytes()

    def chunk(self, chunk: str, lead: str) -> bytes:
        if chunk and max(chunk) >= LATIN_END:
            return self.whole(lead + chunk)
        if self.by_word:
            chunk = chunk.lower()
        if chunk.isalpha():
            return self.merge(lead + chunk)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return (self.tail if lead else self.head)[chunk[:-1]] + self.word[chunk[-1]]
        return b"".join(map(self.word.__getitem__, self.words(lead + chunk)))

    def ids(self, text: str) -> bytes:
        if self.by_word:  # white space only separates words
            if "<|" in text:
                return self.whole(text)
            return b"".join(map(self.head.__getitem__, text.replace("\n", " ").split(" ")))
        chunks = byte_chunks(text)
        if chunks is None:
            return self.whole(text)
        return self.head[chunks[0]] + b"".join(map(self.tail.__getitem__, chunks[1:]))

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; equal chunks of a slice are looked up once."""
        if not len(texts) or self.by_word:
            found = [self.ids(x) for x in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = [0, *(1 + np.flatnonzero(np.diff(sizes // SLICE))), len(texts)]
        found = [self._slice(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if bounds[0] == bounds[-1]:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        starts, odd = _pretokens(data, bounds)
        offsets = np.append(starts, len(data)).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code = own.indices.to_numpy()
        values = self._values(own.dictionary.to_numpy(zero_copy_only=False).tolist(), set(code[np.searchsorted(starts, odd)].tolist()))
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        k = size[code]
        end = np.cumsum(k, dtype=np.int32)
        at = np.repeat((np.cumsum(size, dtype=np.int32) - size)[code] - (end - k), k) + np.arange(end[-1], dtype=np.int32)
        total = np.append(np.int32(0), end)[np.searchsorted(starts, bounds)]
        return np.frombuffer(b"".join(values), "<u4")[at], np.diff(total).astype(np.int64)

    def _values(self, chunks: list[bytes], odd: set[int]) -> list[bytes]:
        """Ids of pre-tokens, and of chunks (at places ``odd``) that the library cuts itself."""
        values = list(map(self.seen.get, chunks))
        for i in odd:
            values[i] = self.odd[chunks[i].decode()]
        fresh = [i for i, x in enumerate(values) if x is None]
        if self.seen.old:
            for i in fresh:
                values[i] = self.seen.old.get(chunks[i])
            self.seen.keep_all((chunks[i], values[i]) for i in fresh if values[i] is not None)
            fresh = [i for i in fresh if values[i] is None]
        for k in range(0, len(fresh), JOINED):
            part = [chunks[i] for i in fresh[k : k + JOINED]]
            # As letters, with a space (no letter stands for a byte by it) between two pre-tokens.
            letters = _POINTS[np.frombuffer(b"\xff".join(part), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model_only.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (1 + np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, part)))))
            ids, stops = ids.tobytes(), ends.tolist()
            found = [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            for i, value in zip(fresh[k : k + JOINED], found, strict=True):
                values[i] = value
            self.seen.keep_all(zip(part, found, strict=True))
        return values


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)

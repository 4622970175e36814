"""Token ids as compressed binary blocks: adaptive context mixing drives an entropy coder.

The ids of a block are cut into lanes that are coded in step as numpy arrays and share one model, so all
lanes learn from each other. An order-2 and an order-1 context each predict the next id, with a confidence; a
symbol says which of them is right, or that neither is. Two adaptive distributions of that symbol, one by the
confidences and one by the previous two symbols, are mixed by a weight that follows the better one. An id that neither
predicts is coded by order 0: an adaptive distribution of all such ids. The contexts learn after each step, the
distributions whenever the ids seen have grown by half. Symbol and id are one interval for
a lane's coder (range asymmetric numeral systems), and all lanes share one stream of words. A block carries its
crc32 and can be read alone. A block with ids of 65,536 and above is coded as two of halves of ids.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in the smallest unit that is worth lanes of its own, and ids of a block.
BLOCK = 4096
SEGMENT = 1 << 22
MAGIC, MAGIC_HALVES = b"QGI3", b"QGH3"
#: Most lanes coded in step, and the ids that a lane has at least.
LANES, RUN = 4096, 256

_SLOTS2 = 1 << 17
#: Bits of the symbol's distribution and of order 0; a symbol keeps ``_LEAST`` units.
_BITS, _BITS0, _LEAST = 11, 19, 8
_UNITS, _UNITS0 = 1 << _BITS, 1 << _BITS0
_SHIFT = _BITS + _BITS0
_MASK, _LIMIT = (1 << _SHIFT) - 1, 1 << 31
#: A state takes words of 32 bits once it would leave 2^31 .. 2^63.
_ROOM = 63 - _SHIFT


def _units(counts: np.ndarray) -> np.ndarray:
    """Counts of the three symbols by context as units of the distribution."""
    counts = counts + 1
    two = _LEAST + (_UNITS - 3 * _LEAST) * counts[:, :2] // counts.sum(1, keepdims=True)
    return np.concatenate([two, _UNITS - two.sum(1, keepdims=True)], 1)


class _Model:
    """What encoder and decoder know before each id; integers only, so both know the same."""

    def __init__(self, alphabet: int, lanes: int, lookup: bool) -> None:
        # The id last seen in a context, and in the lowest two bits how often in a row it was (3 at most).
        self.t2, self.t1 = np.zeros(_SLOTS2, np.int32), np.zeros(1 << 16, np.int32)
        self.last, self.mixed, self.past, self.symbol = (np.zeros(lanes, np.int64) for _ in range(4))
        self.by_sure, self.by_past, self.weight = np.zeros((16, 3), np.int64), np.zeros((9, 3), np.int64), 8
        self.order0, self.lookup = np.zeros(alphabet, np.int64), lookup
        self.held: list[np.ndarray] = []
        self.escaped: list[np.ndarray] = []
        self.steps, self.due = 0, 1
        self.learn()

    def learn(self) -> None:
        """Take what the steps since the last call have shown into the distributions."""
        if self.held:
            shown = np.bincount(np.concatenate(self.held), minlength=432).reshape(16, 9, 3)
            gain = (shown * np.sign(_units(self.by_sure)[:, None, :] - _units(self.by_past)[None, :, :])).sum()
            self.weight = min(15, max(1, self.weight + 2 * int(np.sign(gain))))
            self.by_sure += shown.sum(1)
            self.by_past += shown.sum(0)
            self.order0 += np.bincount(np.concatenate(self.escaped), minlength=len(self.order0))
            self.held, self.escaped = [], []
        mixed = (_units(self.by_sure)[:, None, :] * self.weight + _units(self.by_past)[None, :, :] * (16 - self.weight)) >> 4
        mixed[:, :, 2] = _UNITS - mixed[:, :, 0] - mixed[:, :, 1]
        mixed = mixed.reshape(-1, 3) << _BITS0
        self.size, self.low = mixed.ravel(), (np.cumsum(mixed, 1) - mixed).ravel()
        self.one, self.none = self.low[1::3].copy(), self.low[2::3].copy()
        n, total = len(self.order0), int(self.order0.sum())
        self.size0 = 1 + (_UNITS0 - n) * self.order0 // total if total else np.full(n, _UNITS0 // n)
        self.low0 = np.cumsum(self.size0) - self.size0
        if self.lookup:
            self.id_at = np.full(_UNITS0, n - 1, np.uint16)
            self.id_at[: int(self.size0.sum())] = np.repeat(np.arange(n, dtype=np.uint16), self.size0)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """What order 2 and order 1 expect."""
        self.mixed, before = self.last * 40503, self.mixed
        self.i2 = (self.mixed ^ (before >> 3)) & (_SLOTS2 - 1)
        e2, e1 = self.t2.take(self.i2), self.t1.take(self.last)
        self.sure2, self.sure1 = e2 & 3, e1 & 3
        self.context = self.sure2 * 36 + self.sure1 * 9 + self.past
        return e2 >> 2, e1 >> 2

    def update(self, ids: np.ndarray, symbol: np.ndarray, held: np.ndarray, right2: np.ndarray, right1: np.ndarray, escaped: np.ndarray) -> None:
        fresh = ids << 2
        self.t2[self.i2] = fresh + np.minimum(self.sure2 + 1, 3) * right2
        self.t1[self.last] = fresh + np.minimum(self.sure1 + 1, 3) * right1
        self.held.append(held)
        self.escaped.append(escaped)
        self.past, self.symbol = self.symbol * 3 + symbol, symbol
        self.last = ids
        self.steps += 1
        if self.steps == self.due:
            self.learn()
            self.due += max(1, self.due // 2)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // RUN))


def _encode(ids: np.ndarray) -> bytes:
    """Ids below 65,536: the largest one, the lanes' states, words."""
    lanes = _lanes(len(ids))
    model, steps = _Model(int(ids.max()) + 1, lanes, False), -(-len(ids) // lanes)
    padded = np.concatenate([ids, np.zeros(steps * lanes - len(ids), np.uint32)])
    parts = []
    for x in np.ascontiguousarray(padded.reshape(lanes, steps).T):
        x = x.astype(np.int64)
        p2, p1 = model.predict()
        right2, right1 = p2 == x, p1 == x
        symbol = (2 - right1) * ~right2
        held = model.context * 3 + symbol
        low, size, k = model.low.take(held), model.size.take(held), np.flatnonzero(symbol == 2)
        y, wide = x.take(k), size.take(k) >> _BITS0
        low[k] += wide * model.low0.take(y)
        size[k] = wide * model.size0.take(y)
        parts.append((low.astype(np.uint32), size.astype(np.uint32)))
        model.update(x, symbol, held, right2, right1, y)
    state, words = np.full(lanes, _LIMIT, np.int64), []
    for low, size in reversed(parts):  # the last id goes in first
        size = size.astype(np.int64)
        k = np.flatnonzero((state >> _ROOM) >= size)
        full = state.take(k)
        words.append(full.astype(np.uint32))
        state[k] = full >> 32
        whole = state // size
        state = (whole << _SHIFT) + (state - whole * size) + low
    return int(ids.max()).to_bytes(2, "little") + state.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def _decode(body: bytes, n: int) -> np.ndarray:
    lanes = _lanes(n)
    model, steps = _Model(int.from_bytes(body[:2], "little") + 1, lanes, True), -(-n // lanes)
    state = np.frombuffer(body, "<u8", lanes, 2).astype(np.int64)
    words, read, out = np.frombuffer(body, "<u4", offset=2 + 8 * lanes).astype(np.int64), 0, np.empty((steps, lanes), np.uint32)
    for t in range(steps):
        p2, p1 = model.predict()
        slot = state & _MASK
        after, other = slot >= model.one.take(model.context), slot >= model.none.take(model.context)
        ids, symbol = np.where(after, p1, p2).astype(np.int64), after.astype(np.int64) + other
        held, k = model.context * 3 + symbol, np.flatnonzero(other)
        low, size = model.low.take(held), model.size.take(held)
        start, wide = low.take(k), size.take(k) >> _BITS0
        y = model.id_at.take((slot.take(k) - start) // wide).astype(np.int64)
        low[k], size[k], ids[k] = start + wide * model.low0.take(y), wide * model.size0.take(y), y
        state = size * (state >> _SHIFT) + (slot - low)
        k = np.flatnonzero(state < _LIMIT)
        state[k] = (state.take(k) << 32) | words[read : read + len(k)]
        read += len(k)
        out[t] = ids
        model.update(ids, symbol, held, p2 == ids, p1 == ids, y)
    return np.ascontiguousarray(out.T).ravel()[:n]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids`` (below 2^32) as blocks: magic, count, crc32 of the ids as little-endian uint32, body.

    The body of ids above 65,535 is the length of the body of their low halves, that body, and the body of their high halves.
    """
    out = []
    for i in range(0, len(ids), SEGMENT):
        part = ids[i : i + SEGMENT].astype(np.uint32)
        magic, body = MAGIC, _encode(part & np.uint32(0xFFFF))
        if int(part.max()) >= 1 << 16:
            magic, body = MAGIC_HALVES, len(body).to_bytes(4, "little") + body + _encode(part >> np.uint32(16))
        out.append(magic + len(part).to_bytes(4, "little") + zlib.crc32(part.astype("<u4").tobytes()).to_bytes(4, "little") + body)
    return out


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; one whose magic or crc32 is wrong is refused."""
    if block[:4] not in (MAGIC, MAGIC_HALVES):
        raise ValueError("not a block of token ids")
    n, body = int.from_bytes(block[4:8], "little"), block[12:]
    if block[:4] == MAGIC:
        ids = _decode(body, n)
    else:
        cut = 4 + int.from_bytes(body[:4], "little")
        ids = _decode(body[4:cut], n) | (_decode(body[cut:], n) << np.uint32(16))
    if zlib.crc32(ids.astype("<u4").tobytes()) != int.from_bytes(block[8:12], "little"):
        raise ValueError("a block of token ids is damaged")
    return ids


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    return [decode_block(x) for x in blocks]

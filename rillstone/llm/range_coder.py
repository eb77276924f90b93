"""Adaptive context-mixing range coder for blocks of token ids.

Every block is coded from fresh state, an id in one step. Its probability is a mixture of three predictions: the id that
followed the last two ids here before (order 2), the id that followed the last one (order 1), and the counts of the
block's ids so far (order 0); an id's share is the sum of what all three give it. How much each weighs is counted by
context: whether the latest predictions held, whether both orders agree, and whether they know their contexts. An id that
none of them names follows by a fixed distribution over the vocabulary. Predictions of orders 1 and 2 change with every
step; counts and weights are taken anew at places whose distance grows with the block, so that they are plain tables in
between. The id of order 2 has the first shares, that of order 1 the next, and all others follow in ascending order.

A block is cut into lanes, stretches of equal length that are coded in step by numpy. They share the block's model, which
learns from the ids of all lanes after each step, and one stream of words, in the order in which the decoder asks for them.
The range coder has 48-bit low and range in floats, whose whole numbers are exact, and emits 16-bit words; carries are added to
the words at the end.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

MAGIC = b"RSTK"
VERSION = 5
#: Ids of a block, its most lanes, and the ids that a lane has at least where there are several.
LENGTH, LANES, STRETCH = 1 << 21, 1 << 12, 1 << 9
#: Slots of order 2, contexts of the weights.
SLOTS = 1 << 16
CONTEXTS = 64
#: Shares that the counts of order 0 have together, but for rounding up; steps after which they are taken anew at least.
SHARES, STEPS = 1 << 16, 1 << 6
_TOP, _LOW, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)
#: Counts of how often order 2, order 1 and neither were right, before any id is seen.
_PRIOR = (0.4, 0.2, 2.0)
_MOST = float(1 << 20)
#: Shares before an id's own stand above its number of shares.
_CUM = 20


def lanes_of(n: int) -> int:
    return min(LANES, -(-n // STRETCH))


@functools.cache
def fixed_shares(vocabulary: int) -> tuple[np.ndarray, float]:
    """Cumulative shares of ids that a block has not seen yet (tokenizers give low ids to common tokens), and their sum."""
    share = np.floor(float(1 << 18) / (np.arange(vocabulary) + 512.0)) + 1
    cum = np.r_[0.0, np.cumsum(share)]
    return cum, float(cum[-1])


class Model:
    """Adaptive state of a block; what it predicts depends only on the ids it was told. Beyond the vocabulary are the number
    that stands for no prediction, and the one for ids that aren't counted yet."""

    def __init__(self, lanes: int, vocabulary: int):
        self.none, self.fresh = vocabulary, vocabulary + 1
        self.one, self.two = np.full(vocabulary, self.none, np.int32), np.full(SLOTS, self.none, np.int32)
        self.seen = np.zeros(vocabulary, np.int64)
        self.tally = np.tile(np.array(_PRIOR), (CONTEXTS, 1))
        self.last, self.spread = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.held = np.zeros(lanes, np.uint8)
        self.told: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self.steps, self.n_fresh, self.until = 0, 0, 1
        self.renew()

    def renew(self) -> None:
        """Shares of order 0 and weights, of what was told so far."""
        rate = 1.0
        if self.told:
            ids = np.concatenate(self.told)
            rate = (self.n_fresh + 0.5) / (len(ids) + 1)
            self.seen += np.bincount(ids, minlength=len(self.seen))
            self.tally += np.bincount(np.concatenate(self.outcomes), minlength=CONTEXTS * 3).reshape(-1, 3)
            self.until += max(1, min(self.steps // 2, STEPS) if len(self.last) > 1 else max(self.steps // 2, 15))
        self.told, self.outcomes, self.n_fresh = [], [], 0
        share = np.ceil(self.seen * min(1.0, SHARES / max(int(self.seen.sum()), 1))).astype(np.int64)
        size = int(share.sum())
        escape = int(min(max(size, 1) * rate / (1 - min(rate, 0.5)), SHARES)) + 1
        share = np.r_[share, 0, escape]  # none, fresh
        before = np.cumsum(share) - share
        self.shares = before << _CUM | share
        self.table = np.repeat(np.arange(len(share), dtype=np.int32), share)
        self.whole = float(size + escape)
        hit = self.tally
        w2, w1 = np.minimum(np.floor(hit[:, :2] * (self.whole / hit[:, 2:])) + 1, _MOST).T
        k = np.arange(CONTEXTS)
        w1[(k & 1 > 0) | (k & 4 == 0)] = 0  # named by order 2 already, or no prediction
        w2[k & 2 == 0] = 0
        self.w2, self.w1 = w2.copy(), w1.copy()
        # a little less than 1 / total, so that shares never exceed the range
        self.part = (1 - 2.0**-50) / (w2 + w1 + self.whole)

    def predict(self) -> None:
        """The next ids that orders 2 and 1 name, and where all shares lie."""
        last = self.last
        self.slot = ((last * 40503 + self.spread) >> 2) & (SLOTS - 1)
        c1, c2 = self.one.take(last), self.two.take(self.slot)
        agree = c1 == c2
        self.context = k = (self.held << 3) | (c1 != self.none).view(np.uint8) << 2 | (c2 != self.none).view(np.uint8) << 1 | agree.view(np.uint8)
        c1[agree] = self.none
        self.c1, self.c2 = c1, c2
        p1, p2 = self.shares.take(c1), self.shares.take(c2)
        self.ends2 = self.w2.take(k) + (p2 & (1 << _CUM) - 1)
        self.ends1 = self.ends2 + (self.w1.take(k) + (p1 & (1 << _CUM) - 1))
        self.lower, self.upper = np.minimum(p1, p2), np.maximum(p1, p2)

    def tell(self, x: np.ndarray) -> None:
        """x: the ids that came, a lane each."""
        is2, is1 = self.c2 == x, self.c1 == x
        right = (is1 | is2).view(np.uint8)
        self.outcomes.append(self.context * np.uint8(3) + (2 - right - is2.view(np.uint8)))
        self.told.append(x)
        self.one[self.last] = x
        self.two[self.slot] = x
        self.spread = self.last * 30011
        self.last = x
        self.held = (self.held << 1 & 7) | right
        self.steps += 1
        if self.steps >= self.until:
            self.renew()


def _encode(columns: np.ndarray, vocabulary: int) -> bytes:
    """columns: ids, a row a step and a column a lane."""
    lanes = columns.shape[1]
    m = Model(lanes, vocabulary)
    fixed, total_fixed = fixed_shares(vocabulary)
    low, rng = np.zeros(lanes), np.full(lanes, _TOP)
    all_lanes = np.arange(lanes, dtype=np.uint16)
    at_lanes: list[np.ndarray] = []
    words: list[np.ndarray] = []

    def emit(at: np.ndarray) -> None:
        """Words of the lanes whose range got small."""
        while len(at):
            now = low.take(at)
            word = np.floor(now * (1 / _LOW))
            at_lanes.append(at.astype(np.uint16))
            words.append(word.astype(np.uint32))
            low[at] = (now - word * _LOW) * _WORD
            rng[at] = ra = rng.take(at) * _WORD
            at = at[ra < _LOW]

    low_bits = (1 << _CUM) - 1
    for x in columns:
        m.predict()
        is2, is1 = x == m.c2, x == m.c1
        p = m.shares.take(x)
        new = ((p & low_bits) == 0) & ~is1 & ~is2
        fresh = new.nonzero()[0]
        if len(fresh):
            p[fresh] = m.shares[m.fresh]
        freq = (p & low_bits).astype(float)
        cum = m.ends1 + (p >> _CUM)
        cum -= (m.lower & low_bits) * (m.lower < p)
        cum -= (m.upper & low_bits) * (m.upper < p)
        cum[is1] = m.ends2[is1]
        freq[is1] = (m.ends1 - m.ends2)[is1]
        cum[is2] = 0
        freq[is2] = m.ends2[is2]
        r = np.floor(rng * m.part.take(m.context))
        low += r * cum
        np.multiply(r, freq, out=rng)
        emit((rng < _LOW).nonzero()[0])
        if len(fresh):
            m.n_fresh += len(fresh)
            ids = x[fresh]
            q = np.floor(rng[fresh] / total_fixed)
            low[fresh] += q * fixed[ids]
            rng[fresh] = ra = q * (fixed[ids + 1] - fixed[ids])
            emit(fresh[ra < _LOW])
        m.tell(x)
    n = sum(map(len, words))
    for _ in range(3):
        word = np.floor(low * (1 / _LOW))
        at_lanes.append(all_lanes)
        words.append(word.astype(np.uint32))
        low = (low - word * _LOW) * _WORD
    order = np.argsort(np.concatenate(at_lanes), kind="stable")  # by lane, each in its order
    w = np.concatenate(words)[order]
    while (over := w >> 16).any():
        w &= 0xFFFF
        w[:-1] += over[1:]
    # the decoder begins with three words of each lane, and where the encoder emits one it asks for the third after it
    out = np.empty(len(w), "<u2")
    emitted = order < n
    out[order[emitted] + 3 * lanes] = w[3:][emitted[:-3]]
    ends = np.searchsorted(np.concatenate(at_lanes)[order], all_lanes)
    out[: 3 * lanes] = w[ends + np.arange(3)[:, None]].ravel()
    return out.tobytes()


def _decode(data: bytes, length: int, lanes: int, vocabulary: int) -> np.ndarray:
    """The columns of _encode. Of damaged data it gives some ids of the vocabulary, or a ValueError."""
    m = Model(lanes, vocabulary)
    fixed, total_fixed = fixed_shares(vocabulary)
    stream = np.frombuffer(data, "<u2").astype(float)
    pos = 3 * lanes
    if len(stream) < pos:
        raise ValueError("words are missing")
    rng = np.full(lanes, _TOP)
    code = (stream[:lanes] * _WORD + stream[lanes : 2 * lanes]) * _WORD + stream[2 * lanes : pos]

    def fill(at: np.ndarray) -> None:
        """More words for the lanes whose range got small."""
        nonlocal pos
        while len(at):
            if pos + len(at) > len(stream):
                raise ValueError("words are missing")
            code[at] = code.take(at) * _WORD + stream[pos : pos + len(at)]
            pos += len(at)
            rng[at] = ra = rng.take(at) * _WORD
            at = at[ra < _LOW]

    low_bits = (1 << _CUM) - 1
    columns = np.zeros((length, lanes), np.int32)
    for x in columns:
        m.predict()
        r = np.floor(rng * m.part.take(m.context))
        v = np.floor(code / r)
        is2, below = v < m.ends2, v < m.ends1
        is1 = below & ~is2
        u = (v - m.ends1).astype(np.int64)
        n = m.lower & low_bits
        shift = n * (u >= m.lower >> _CUM)
        n = m.upper & low_bits
        shift += n * (u + shift >= m.upper >> _CUM)
        u += shift
        m.table.take(u, out=x, mode="clip")
        p = m.shares.take(x)
        freq = (p & low_bits).astype(float)
        cum = m.ends1 + ((p >> _CUM) - shift)
        i = is1.nonzero()[0]
        x[i] = m.c1[i]
        cum[i] = m.ends2[i]
        freq[i] = m.ends1[i] - m.ends2[i]
        i = is2.nonzero()[0]
        x[i] = m.c2[i]
        cum[i] = 0
        freq[i] = m.ends2[i]
        code -= r * cum
        np.multiply(r, freq, out=rng)
        fill((rng < _LOW).nonzero()[0])
        fresh = (x > m.none).nonzero()[0]
        if len(fresh):
            m.n_fresh += len(fresh)
            q = np.floor(rng[fresh] / total_fixed)
            u = np.minimum(np.maximum(code[fresh] / q, 0), total_fixed - 1)
            x[fresh] = ids = fixed.searchsorted(u, "right") - 1
            code[fresh] -= q * fixed[ids]
            rng[fresh] = ra = q * (fixed[ids + 1] - fixed[ids])
            fill(fresh[ra < _LOW])
        m.tell(x)
    return columns


def encode_ids(ids: np.ndarray, vocabulary: int, length: int = LENGTH) -> bytes:
    """MAGIC, version, vocabulary, block length, number of ids, then each block's crc32 and size, then the blocks."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id lies outside the vocabulary")
    if not 0 < length <= LENGTH:
        raise ValueError(f"a block has 1 to {LENGTH} ids")
    table, parts = [], []
    for a in range(0, len(ids), length):
        block = ids[a : a + length].astype("<i4")
        lanes = lanes_of(len(block))
        steps = -(-len(block) // lanes)
        full = np.zeros(lanes * steps, np.int32)
        full[: len(block)] = block
        parts.append(_encode(np.ascontiguousarray(full.reshape(lanes, steps).T), vocabulary))
        table.append(struct.pack("<II", zlib.crc32(block), len(parts[-1])))
    return b"".join([MAGIC, struct.pack("<BIIQ", VERSION, vocabulary, length, len(ids)), *table, *parts])


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of encode_ids; a ValueError if a block's checksum doesn't hold."""
    size = len(MAGIC) + 17
    version, vocabulary, length, n = struct.unpack("<BIIQ", data[len(MAGIC) : size])
    if data[: len(MAGIC)] != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    out = np.empty(n, np.int32)
    blocks = -(-n // length)
    at = size + 8 * blocks
    for k in range(blocks):
        crc, held = struct.unpack_from("<II", data, size + 8 * k)
        block = out[k * length : (k + 1) * length]
        lanes = lanes_of(len(block))
        try:
            with np.errstate(all="ignore"):  # of damaged parts
                block[:] = _decode(data[at : at + held], -(-len(block) // lanes), lanes, vocabulary).T.ravel()[: len(block)]
        except (ValueError, IndexError) as e:
            raise ValueError(f"the checksum of block {k} doesn't hold: {e}") from e
        if zlib.crc32(block.astype("<u4", copy=False)) != crc:
            raise ValueError(f"the checksum of block {k} doesn't hold")
        at += held
    return out

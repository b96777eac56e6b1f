"""Adaptive context-mixing range coder for token ids.

A block codes a run of ids by itself. Its ids are cut into lanes of equal length that are
coded side by side: at each step every lane has one id, all are coded with one shared
model, and the model then learns from all of them. Array operations over the lanes keep
the step cheap, in both directions.

The model mixes three predictions of the next id:
  order 0  counts of all ids so far, over the whole vocabulary;
  order 1  the id that last followed the previous id, with a confidence of 0 to 7;
  order 2  the same for the previous two ids (hashed).
How much weight orders 1 and 2 get is learnt for each pair of confidences from how often
they were right. Counts of order 0 are halved, to 1 at least, before their total outgrows the range. The mixture is one cumulative distribution over the vocabulary, so
one arithmetic coding step codes the id, with a 64-bit range and bytewise output.

A range is divided by multiplying it with a reciprocal that is a little too small, in double precision: both
directions do the same operations on the same numbers, so they get the same quotient.

Block: magic, header, bytes of each lane, lanes; the header has a CRC-32 of all that
follows and one of the ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
HEADER = struct.Struct("<4sIIIII")  # magic, ids, vocabulary, lanes, CRC-32 of the coded bytes, CRC-32 of the ids
STEP, WEIGHT_BITS, CONTEXT_BITS = 32, 12, 18
WEIGHT = 1 << WEIGHT_BITS
BOTTOM, WORD = np.uint64(1 << 40), np.uint64(40)  # a range's least size; the place of its three leading bytes
SETTLED = [np.uint64(1 << b) for b in (56, 48, 40)]
#: A guess and its confidence in one number: the id, shifted, and three bits.
SURE_BITS, SURE = 3, 7


class Mixer:
    """The shared model. ``predict`` and ``learn`` see the same arrays when coding and decoding."""

    def __init__(self, vocabulary: int, lanes: int):
        self.counts = np.ones(vocabulary, np.int64)
        self.below = np.zeros(vocabulary + 1, np.int64)
        self.one, self.two = np.zeros(vocabulary, np.int32), np.zeros(1 << CONTEXT_BITS, np.int32)
        self.seen = np.full(128, 16, np.int64)
        self.right_one, self.right_two = np.ones(128, np.int64), np.ones(128, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, lanes: int) -> tuple[np.ndarray, ...]:
        """For each lane: weight of order 0, the ids that orders 2 and 1 favour, and their weights."""
        np.cumsum(self.counts, out=self.below[1:])
        while 2 * int(self.below[-1]) * WEIGHT > int(BOTTOM) and self.counts.max() > 1:  # else a lane's range could be too small to be divided
            self.counts = (self.counts + 1) >> 1
            np.cumsum(self.counts, out=self.below[1:])
        two = self.right_two * (WEIGHT - 64) // self.seen
        one = np.minimum(self.right_one * (WEIGHT - 64) // self.seen, WEIGHT - 32 - two)
        one[1::2] = 0  # both favour the same id
        self.at_one = self.last[:lanes]
        self.at_two = ((self.before[:lanes] * 0x9E3779B1 + self.at_one * 0x85EBCA6B) >> 7) & ((1 << CONTEXT_BITS) - 1)
        self.held_two, self.held_one = self.two[self.at_two], self.one[self.at_one]
        self.a, self.b = self.held_two >> SURE_BITS, self.held_one >> SURE_BITS
        self.cell = ((self.held_two & SURE) << 4) | ((self.held_one & SURE) << 1) | (self.a == self.b)
        a_weight, b_weight = two[self.cell], one[self.cell]
        return WEIGHT - a_weight - b_weight, self.a, self.b, a_weight, b_weight

    def learn(self, ids: np.ndarray) -> None:
        n = len(ids)
        np.add.at(self.counts, ids, STEP)
        hit_two, hit_one = self.a == ids, self.b == ids
        seen = np.bincount((self.cell << 2) | (hit_two.view(np.uint8) << 1) | hit_one, minlength=512).reshape(128, 2, 2)
        self.seen += seen.sum((1, 2))
        self.right_two += seen[:, 1].sum(1)
        self.right_one += seen[:, :, 1].sum(1)
        fresh = ((ids << SURE_BITS) | 1).astype(np.int32)
        for table, at, held, hit in ((self.two, self.at_two, self.held_two, hit_two), (self.one, self.at_one, self.held_one, hit_one)):
            was = held & SURE
            missed = np.where(was > 1, held - was + (was >> 1), fresh)
            table[at] = np.where(hit, held + (was < SURE), missed)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


#: Lanes at most, as a power of two, and ids that a lane should have at least: a step costs a sum over the vocabulary, so lanes are many rather than long.
LANE_BITS, LANE_IDS = 13, 192


def _shape(n: int) -> tuple[int, int]:
    """Lanes and ids in each lane (fewer in the last)."""
    lanes = max(1, min(1 << LANE_BITS, n // LANE_IDS))
    length = -(-n // lanes)
    return -(-n // length) if n else 0, length


def _unit(span: np.ndarray, total: int) -> np.ndarray:
    """What one part of ``total`` gets of each range, at least 1 if the range is twice the total."""
    return (span.astype(np.float64) * ((1.0 - 2.0**-50) / total)).astype(np.uint64)


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """How many leading bytes of each lane can change no more, up to three.

    A lane whose range is too small for that to happen by itself is cut down to one leading byte.
    """
    open_bits = low ^ (low + span)
    n = sum((open_bits < b).view(np.uint8) for b in SETTLED)
    short = (n == 0) & (span < BOTTOM)
    if short.any():
        span[short] = (np.uint64(0) - low[short]) & (BOTTOM - np.uint64(1))
        n[short] = 1
    return n


#: Lanes whose bytes are put in order at once: few enough for a processor's cache.
LANES_AT_ONCE = 64


def _by_lane(words: np.ndarray, counts: np.ndarray) -> bytes:
    """Number of bytes of each lane, then the lanes' bytes, from what each step (a row) gave off: the lower ``counts`` bytes of ``words``."""
    parts = [counts.sum(0, dtype="<u4").tobytes()]
    for a in range(0, words.shape[1], LANES_AT_ONCE):
        word, count = (x[:, a : a + LANES_AT_ONCE].T.ravel() for x in (words, counts))
        until = np.cumsum(count, dtype=np.int64)
        back = np.repeat(until, count) - np.arange(1, until[-1] + 1)  # bytes of the word that come after this one
        parts.append((np.repeat(word, count) >> (back << 3).view(np.uint64)).astype(np.uint8).tobytes())
    return b"".join(parts)


def encode_block(ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    vocabulary = int(ids.max()) + 1 if n else 0
    lanes, length = _shape(n)
    body = b""
    if n:
        grid = np.zeros(lanes * length, np.uint32)
        grid[:n] = ids
        grid = grid.reshape(lanes, length).T.copy()
        full = n - (lanes - 1) * length  # steps in which the last lane takes part
        model, words, counts = Mixer(vocabulary, lanes), np.zeros((length + 1, lanes), np.uint64), np.zeros((length + 1, lanes), np.uint8)
        low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        with np.errstate(over="ignore"):
            for t in range(length):
                k = lanes if t < full else lanes - 1
                s = grid[t, :k].astype(np.int64)
                rest, a, b, a_weight, b_weight = model.predict(k)
                total = int(model.below[-1])
                start = rest * model.below[s] + total * (a_weight * (a < s) + b_weight * (b < s))
                size = rest * model.counts[s] + total * (a_weight * (a == s) + b_weight * (b == s))
                part, width = low[:k], span[:k]
                unit = _unit(width, total * WEIGHT)
                part += unit * start.view(np.uint64)
                np.multiply(unit, size.view(np.uint64), out=width)
                word, count = words[t], counts[t]
                rows: np.ndarray | slice = slice(0, k)
                while True:  # a step gives off up to six bytes
                    gone = _settled(part, width)
                    bits = gone.astype(np.uint64) << np.uint64(3)
                    word[rows] = (word[rows] << bits) | ((part >> WORD) >> (np.uint64(24) - bits))
                    count[rows] += gone
                    part <<= bits
                    width <<= bits
                    low[rows], span[rows] = part, width
                    again = np.flatnonzero((gone == 3) | (width < BOTTOM))
                    if not len(again):
                        break
                    rows = np.arange(k)[again] if isinstance(rows, slice) else rows[again]
                    part, width = low[rows], span[rows]
                model.learn(s)
        words[length], counts[length] = low, 8
        body = _by_lane(words, counts)
    return HEADER.pack(MAGIC, n, vocabulary, lanes, zlib.crc32(body), zlib.crc32(ids.tobytes())) + body


def _quotient(over: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Whole quotients below 2**40, by doubles that are then put right."""
    q = (over.astype(np.float64) / unit.astype(np.float64)).astype(np.uint64)
    q -= (q * unit > over).view(np.uint8)
    q += ((q + np.uint64(1)) * unit <= over).view(np.uint8)
    return q


def _places(below: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The id within whose counts each value (below 2**40) lies. Values are looked up in order, several times faster than as they come."""
    key = (value << LANE_BITS) | np.arange(len(value))
    key.sort()
    out = np.empty(len(value), np.int64)
    out[key & ((1 << LANE_BITS) - 1)] = np.searchsorted(below, key >> LANE_BITS, "right") - 1
    return out


def decode_block(block: bytes) -> np.ndarray:
    """The ids; ValueError if a checksum doesn't hold."""
    magic, n, vocabulary, lanes, body_crc, ids_crc = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, "<u4")
    length = _shape(n)[1]
    full = n - (lanes - 1) * length
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    data = np.concatenate([np.frombuffer(body, np.uint8, offset=4 * lanes), np.zeros(8, np.uint8)]).astype(np.uint32)
    at = np.cumsum(sizes) - sizes
    ahead = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # three bytes from each on
    model = Mixer(vocabulary, lanes)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(8):
        code = (code << np.uint64(8)) | data[at]
        at += 1
    grid = np.zeros((length, lanes), "<u4")
    with np.errstate(over="ignore"):
        for t in range(length):
            k = lanes if t < full else lanes - 1
            rest, a, b, a_weight, b_weight = model.predict(k)
            below, total = model.below, int(model.below[-1])
            part, width, own = low[:k], span[:k], code[:k]
            unit = _unit(width, total * WEIGHT)
            value = np.minimum(_quotient(own - part, unit), np.uint64(total * WEIGHT - 1)).view(np.int64)
            swap = a > b
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            lo_mass, hi_mass = total * np.where(swap, b_weight, a_weight), total * np.where(swap, a_weight, b_weight)
            lo_start, hi_start = rest * below[lo], rest * below[hi] + lo_mass * (lo < hi)
            lo_end, hi_end = rest * below[lo + 1] + lo_mass + hi_mass * (lo == hi), rest * below[hi + 1] + lo_mass + hi_mass
            plain = value - lo_mass * (value >= lo_end) - hi_mass * (value >= hi_end)
            s = _places(below, (plain / rest).astype(np.int64))
            s = np.where((value >= hi_start) & (value < hi_end), hi, s)
            s = np.where((value >= lo_start) & (value < lo_end), lo, s)
            start = rest * below[s] + total * (a_weight * (a < s) + b_weight * (b < s))
            size = rest * model.counts[s] + total * (a_weight * (a == s) + b_weight * (b == s))
            part += unit * start.view(np.uint64)
            np.multiply(unit, size.view(np.uint64), out=width)
            rows: np.ndarray | slice = slice(0, k)
            while True:
                gone = _settled(part, width)
                bits = gone.astype(np.uint64) << np.uint64(3)
                part <<= bits
                width <<= bits
                low[rows], span[rows] = part, width
                code[rows] = (code[rows] << bits) | (ahead[at[rows]] >> (np.uint64(24) - bits))
                at[rows] += gone
                again = np.flatnonzero((gone == 3) | (width < BOTTOM))
                if not len(again):
                    break
                rows = np.arange(k)[again] if isinstance(rows, slice) else rows[again]
                part, width = low[rows], span[rows]
            grid[t, :k] = s
            model.learn(s)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block doesn't decode to its ids")
    return ids

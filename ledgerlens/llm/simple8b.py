"""Simple-8b: whole numbers packed into 64-bit words, vectorised.

The top four bits of a word are its selector.  Selectors 1 to 14 hold 60, 30,
20, ... 1 numbers of 1, 2, 3, ... 60 bits; each word takes as many of the next
numbers as fit.  Selector 0 is an escape: a number of more than 60 bits, kept
whole in a list beside the words, with its place there as payload.

Numbers are packed in blocks of a fixed count; no word crosses a block, and the
first word and escape of every block are listed, so any range of numbers is
decoded from its own blocks alone.  A packed array as bytes, all little-endian:

    magic "S8B1" | u32 numbers a block | u64 numbers | u64 words | u64 escapes
    | u64 first word of each block, and the end | u64 first escape of each
    block, and the end | u64 words | u64 escapes
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
#: Fixed values of the coding: numbers in a word, by selector from 1 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
PAYLOAD = 60
MAGIC = b"S8B1"
#: Numbers in a block.
BLOCK = 1024
#: Blocks that are packed at once.
_BLOCKS = 1024
_HEAD = "<4sIQQQ"
_HEAD_BYTES = struct.calcsize(_HEAD)
_ESCAPE = len(COUNTS)  # a choice after the last selector


def _bits(count: int) -> int:
    return PAYLOAD // count


def _limits() -> np.ndarray:
    return np.array([1 << _bits(c) for c in COUNTS], U64)


#: Place in :data:`COUNTS` of the narrowest selector of each small number.
_NARROWEST = np.searchsorted(_limits(), np.arange(1 << 16, dtype=U64), "right").astype(np.uint8)


def _choices(numbers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For a word that began at each number: its selector's place in
    :data:`COUNTS` (:data:`_ESCAPE`: an escape), and the numbers it takes."""
    n, blocks = len(numbers), -(-len(numbers) // block)
    limits = _limits()
    pad = COUNTS[0]
    least = np.full((blocks, block + pad), 255, np.uint8)  # the narrowest selector of each number; no word leaves a block
    flat = np.full(blocks * block, 255, np.uint8)
    if numbers.max() < len(_NARROWEST):
        flat[:n] = _NARROWEST[numbers.astype(np.int64)]
    else:
        flat[:n] = np.searchsorted(limits, numbers, "right")
    least[:, :block] = flat.reshape(blocks, block)
    spans, span = {1: least}, 1
    while 2 * span <= COUNTS[0]:
        wide = spans[span].copy()
        np.maximum(wide[:, :-span], spans[span][:, span:], out=wide[:, :-span])
        span *= 2
        spans[span] = wide
    choice = np.full((blocks, block), _ESCAPE, np.uint8)
    for c in range(len(COUNTS) - 1, -1, -1):  # fuller selectors overrule emptier ones
        count = COUNTS[c]
        span = 1 << (count.bit_length() - 1)
        most = np.maximum(spans[span][:, :block], spans[span][:, count - span:count - span + block])
        choice[most <= c] = c
    choice = choice.ravel()[:n]
    return choice, np.array([*COUNTS, 1], np.int64)[choice]


def pack(numbers: np.ndarray, block: int = BLOCK) -> bytes:
    """The packed form of unsigned 64-bit numbers."""
    numbers = np.ascontiguousarray(numbers, U64)
    n, blocks = len(numbers), -(-len(numbers) // block)
    firsts, choices = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for low in range(0, n, block * _BLOCKS):  # a bounded number of blocks at a time
        choice, taken = _choices(numbers[low:low + block * _BLOCKS], block)
        starts, step, i = [], taken.tolist(), 0
        while i < len(step):
            starts.append(i)
            i += step[i]
        firsts.append(np.array(starts, np.int64) + low)
        choices.append(choice[starts])
    first, chosen = np.concatenate(firsts), np.concatenate(choices)
    words = np.zeros(len(first), U64)
    for c, count in enumerate(COUNTS):
        mine = np.flatnonzero(chosen == c)
        if len(mine):
            at = np.arange(count)
            values = numbers[first[mine][:, None] + at] << (at * _bits(count)).astype(U64)
            words[mine] = np.bitwise_or.reduce(values, axis=1) | U64((c + 1) << PAYLOAD)
    edges = np.arange(blocks + 1) * block
    first_word = np.searchsorted(first, edges).astype("<u8")
    escaped = np.flatnonzero(chosen == _ESCAPE)
    first_escape = np.searchsorted(first[escaped], edges).astype("<u8")
    words[escaped] = np.arange(len(escaped), dtype=U64)
    return b"".join([struct.pack(_HEAD, MAGIC, block, n, len(words), len(escaped)), first_word.tobytes(), first_escape.tobytes(),
                     words.astype("<u8").tobytes(), numbers[first[escaped]].astype("<u8").tobytes()])


def size_of(packed: bytes) -> int:
    """How many numbers a packed array holds."""
    return struct.unpack_from(_HEAD, packed)[2]


def unpack(packed: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Numbers ``start`` to ``stop`` (all: the default), decoded from the
    blocks that hold them; an error for bytes of another format."""
    magic, block, n, n_words, n_escapes = struct.unpack_from(_HEAD, packed)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b array")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, U64)
    blocks = -(-n // block)
    first_word = np.frombuffer(packed, "<u8", blocks + 1, _HEAD_BYTES)
    body = _HEAD_BYTES + 16 * (blocks + 1)
    escapes = np.frombuffer(packed, "<u8", n_escapes, body + 8 * n_words)
    b0, b1 = start // block, -(-stop // block)
    w0, w1 = int(first_word[b0]), int(first_word[b1])
    words = np.frombuffer(packed, "<u8", w1 - w0, body + 8 * w0).astype(U64)
    selector = (words >> U64(PAYLOAD)).astype(np.int64)
    counts = np.array([1, *COUNTS], np.int64)[selector]
    ends = np.cumsum(counts)
    if ends[-1] != min(b1 * block, n) - b0 * block:
        raise ValueError("damaged Simple-8b array")
    out = np.empty(int(ends[-1]), U64)
    first = ends - counts
    for s, count in enumerate(COUNTS, 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            at = np.arange(count)
            values = words[mine][:, None] >> (at * _bits(count)).astype(U64)
            out[first[mine][:, None] + at] = values & U64((1 << _bits(count)) - 1)
    mine = np.flatnonzero(selector == 0)
    out[first[mine]] = escapes[words[mine].astype(np.int64)]
    return out[start - b0 * block:stop - b0 * block]

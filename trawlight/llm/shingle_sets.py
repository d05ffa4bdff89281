"""Sets of word shingles as sorted 64-bit hashes, whole batches at a time.

A word's hash is a polynomial in the bytes of the word, taken from running sums over a stretch of
text, so that all words of a stretch are hashed by a few array operations. A shingle's hash is
mixed from its words' hashes; no word and no shingle is ever spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK_BYTES = 4 << 20
_STRETCH = 1 << 20
# Odd multipliers; any would do.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# One random number per byte; A-Z have those of a-z.
_BYTES = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]

_powers = {}


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    if len(_powers.get(base, ())) < size:
        steps = np.full(max(size, _STRETCH), base)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scrambled one to one."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _stretch_hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a stretch that cuts no word, and where each word begins."""
    word = ~space
    begins = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([space[1:], [True]]))
    sums = np.cumsum(_BYTES[data] * _power_table(_STEP, len(data))[: len(data)], dtype=np.uint64)
    before = np.where(begins > 0, sums[begins - 1], np.uint64(0))
    return mixed((sums[ends] - before) * _power_table(_BACK, len(data))[begins]), begins


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and where each text's words begin."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    # A word ends with its text, so the texts are set apart by a space.
    starts = offsets - offsets[0] + np.arange(len(offsets))
    spaced = np.full(len(data) + len(texts), 0x20, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[starts[1:] - 1] = False
    spaced[inside] = data
    space = _SPACE[spaced]
    hashes, begins, first = [], [], 0
    while first < len(spaced):
        last = first + _STRETCH
        if last < len(spaced):  # cut after the last space, or, in a very long word, after the next
            gaps = np.flatnonzero(space[first:last])
            last = first + int(gaps[-1]) + 1 if len(gaps) else last + int(np.argmax(space[last:])) + 1
        found, at = _stretch_hashes(spaced[first:last], space[first:last])
        hashes.append(found)
        begins.append(at + first)
        first = last
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), starts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place on, in order."""
    hashes = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for step in range(width):
        hashes = mixed(hashes * _STEP + words[step : step + len(hashes)])
    return hashes


def blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of consecutive texts of some megabytes, with the first one's place."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        limit = (ends[first - 1] if first else 0) + _BLOCK_BYTES
        last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
        yield first, texts[first:last]
        first = last


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, ascending."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per block of texts its first place and each text's shingles, distinct and ascending.

    A text of fewer words is one shingle, one without words or a null has none.
    """
    for first, some in blocks(texts):
        words, bounds = word_hashes(some)
        hashes = shingle_hashes(words, width)
        sets = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= width:
                sets.append(distinct(hashes[a : b - width + 1]))
            else:
                sets.append(shingle_hashes(words[a:b], b - a) if b > a else words[:0])
        yield first, sets


"""64-bit hashes of the words of whole texts, computed over the byte buffer of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 2 << 20
RADIX = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


END = int(mix(np.array([0x656E64], np.uint64))[0])
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(RADIX))
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, WINDOW + 1)
        for base, name in ((RADIX, "_powers"), (pow(RADIX, -1, 1 << 64), "_inverses")):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            globals()[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers, _inverses


def _window_end(data: np.ndarray, rows: np.ndarray, low: int, high: int) -> int:
    """End of a window that starts at ``low`` and cuts no word."""
    end = low + WINDOW
    if end >= high:
        return high
    near = max(low, end - 4096)
    tail = data[near:end]
    blank = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
    row = int(rows[np.searchsorted(rows, end, "right") - 1])
    best = max(row, near + int(blank[-1]) + 1 if len(blank) else 0)
    if best > low:
        return best
    ahead = data[end:high]
    blank = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
    row = int(rows[np.searchsorted(rows, end, "left")])
    return min(row, end + int(blank[0]) if len(blank) else high)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: the words of row i, A-Z lower-cased, and one end token behind them.

    Words are stretches without ASCII white space; a null is an empty text.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    rows = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    hashes, begins = [], []
    low, high = int(rows[0]), int(rows[-1])
    while low < high:
        end = _window_end(data, rows, low, high)
        part = data[low:end]
        visible = ~((part == 32) | ((part >= 9) & (part <= 13)))
        breaks = rows[np.searchsorted(rows, low, "right"):np.searchsorted(rows, end, "left")] - low
        opens = visible.copy()
        opens[1:] &= ~visible[:-1]
        opens[breaks] = visible[breaks]
        closes = visible.copy()
        closes[:-1] &= ~visible[1:]
        closes[breaks - 1] = visible[breaks - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        powers, inverses = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers[:len(part)], out=sums[1:])
        raw = (sums[last] - sums[first]) * inverses[first]
        hashes.append(mix(raw + (last - first).astype(np.uint64)))
        begins.append(first + low)
        low = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    cuts = np.searchsorted(starts, rows)
    return np.insert(words, cuts[1:], np.uint64(END)), cuts + np.arange(len(cuts))

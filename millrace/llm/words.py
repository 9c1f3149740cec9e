"""Words of a batch of texts as 64-bit hashes, computed with numpy over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_B = np.uint64(0x9E3779B97F4A7C15)
_LOWER_TABLE = bytes(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word [^\\x20\\x09-\\x0D]+ of the texts in order, and for each text where its words begin (n + 1 offsets).

    Equal words have equal hashes wherever they stand. A word's hash sums its bytes, each put through the mixer with
    its place in the word.
    """
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.translate(_LOWER_TABLE)
    data = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    starts = starts[: len(ends)]
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(0x51ED27))
    # eight bytes of all words at a time
    padded = np.frombuffer(joined + b"\0" * 8, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, shape=(len(joined) + 1, 8), strides=(1, 1))
    left, at, which, first = length.copy(), starts.copy(), None, True
    while len(left):
        part = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        cut = np.minimum(left, 8)
        part = part & (~np.uint64(0) >> ((8 - cut).astype(np.uint64) * np.uint64(8)))
        if first:
            h = mix((h ^ part) * _B)
        else:
            h[which] = mix((h[which] ^ part) * _B)
        more = np.flatnonzero(left > 8)
        which = more if first else which[more]
        left, at, first = left[more] - 8, at[more] + 8, False
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, bounds)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the last n - 1 places are missing. Grams across texts are for the caller to drop."""
    have, poly, base = 0, None, _B
    part, size = h, 1  # the polynomial of `size` words, from which that of n is put together by doubling
    while True:
        if n & size:
            if poly is None:
                poly, have = part, size
            else:
                m = max(0, len(h) - have - size + 1)
                poly, have = poly[:m] * base + part[have : have + m], have + size  # base is B to the power size
        if size * 2 > n:
            return mix(poly + np.uint64(n)) if len(h) >= n else np.zeros(0, dtype=np.uint64)
        m = max(0, len(h) - 2 * size + 1)
        part, size, base = part[:m] * base + part[size : size + m], size * 2, np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about most_bytes of text each (one longer text is a slice of its own), texts as UTF-8; null is empty."""
    for batch in batches:
        begin = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > begin and size + n > most_bytes:
                yield _slice(batch, column, begin, i)
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield _slice(batch, column, begin, batch.num_rows)


def _slice(batch: pa.RecordBatch, column: str, begin: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(begin, end - begin)
    return part, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(column)]

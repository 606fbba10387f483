"""Lower-cased terms of texts, cut out of whole Arrow columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a term: 0-9, A-Z, a-z and whatever isn't ASCII, of which UTF-8 makes bytes from 0x80.
IN_TERM = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])
LOWER = bytes(range(256)).lower()
#: Bytes of text that are cut at a time.
CHUNK = 4 << 20


def term_chunks(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """All terms of a column of texts, in order, and for each the row that it stands in.

    A term is a maximal run of characters other than ASCII ones that are neither
    digits nor letters; only A-Z are lower-cased. Null has none. Some megabytes
    are cut at a time, long texts between terms.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, total = offsets[0], int(offsets[-1] - offsets[0])
    starts = offsets[:-1] - base
    data = memoryview(texts.buffers()[2] or b"")[base : base + total]
    at = 0
    while at < total:
        width = chunk
        while True:
            end = min(at + width, total)
            raw = np.frombuffer(data[at:end], dtype=np.uint8)
            inside = IN_TERM[raw]
            heads = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at
            if end == total:
                break
            gaps = np.flatnonzero(~inside)
            stop = max(int(gaps[-1]) + 1 if len(gaps) else 0, int(heads[-1]) if len(heads) else 0)
            if stop:
                end, raw, inside, heads = at + stop, raw[:stop], inside[:stop], heads[heads < stop]
                break
            width *= 2  # one term fills the chunk
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[heads] = False
        first = np.flatnonzero(inside & ~before)
        if len(first):
            kept = np.cumsum(inside)
            ends = np.append(kept[first] - 1, kept[-1]).astype(np.int64)
            letters = raw[inside].tobytes().translate(LOWER)
            yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters)]), np.searchsorted(starts, first + at, side="right") - 1
        at = end


def term_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, rows, places in the vocabulary, occurrences), the last three by row and place."""
    n, size = np.zeros(len(texts), dtype=np.int64), max(len(vocabulary), 1)
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for terms, rows in term_chunks(texts):
        n += np.bincount(rows, minlength=len(texts))
        found = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        known = found >= 0
        key, count = np.unique(rows[known] * size + found[known], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return n, key // size, key % size, count


def lists(rows: np.ndarray, size: int, *values: pa.Array) -> list[pa.ListArray]:
    """Values that stand by row as one list for each of ``size`` rows."""
    offsets = pa.array(np.searchsorted(rows, np.arange(size + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, x) for x in values]

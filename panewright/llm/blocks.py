"""Texts in blocks of some megabytes, for models of n-grams.

What a block has of one word or n-gram is counted once and asked for once, so what is shuffled are
the different ones of a block and not all of its text. Numbers travel packed: sorted, as differences, byte plane by byte plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from .common import mix

U = np.uint64
#: Bytes of text in a block, and what each row counts for besides its text.
BLOCK, ROW = 10 << 20, 64


def pack(a: np.ndarray) -> bytes:
    """All first bytes of a's numbers, then all second ones and so on, compressed: the high bytes of small numbers take no room."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes) if planes else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(raw) if raw else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """pack() of an increasing sequence of unsigned numbers."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK) -> Iterator[pa.Table]:
    """The rows in tables of about `most` bytes of the column at place `text`; a longer text is in a table of its own or the last of one."""
    held, size = [], 0
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(text).fill_null("")).to_numpy().astype(np.int64) + ROW)
        at = 0
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + most - size, "right")))
            held.append(b.slice(at, end - at))
            size += int(upto[end - 1]) - before
            at = end
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def chunks(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(each chunk between white space, as its place in the third; chunks of each text; the different chunks). Null: none."""
    split = pc.utf8_split_whitespace(texts.combine_chunks().fill_null(""))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    text, flat = pc.list_parent_indices(split), split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    flat, text = flat.filter(some).dictionary_encode(), text.filter(some)
    sizes = np.bincount(text.to_numpy(), minlength=len(split))
    return flat.indices.to_numpy().astype(np.int64), sizes, flat.dictionary.to_pylist()


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """np.argsort(key, kind="stable") of whole numbers from 0 to below 2**bits, 64 bits at most.

    Sorts numbers that hold the place below the upper bits of the key, which is some times faster; keys that differ in the bits left out are put right at the end.
    """
    place = max(1, (len(key) - 1).bit_length())
    out = max(0, bits + place - 64)
    order = np.sort((key.astype(U, copy=False) >> U(out)) << U(place) | np.arange(len(key), dtype=U))
    order = (order & U((1 << place) - 1)).astype(np.int64)
    if out:
        key = key[order]
        if (key[1:] < key[:-1]).any():
            order = order[np.argsort(key, kind="stable")]
    return order


def by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by shard and 48 bits of the key, these bits in this order, where each of the shards begins and the last one ends).

    The shard depends on other bits, so different keys are taken for one if 48 bits and the shard agree: of n keys about n^2 / 2^49 / shards.
    """
    shard = mix(key ^ U(0x5851F42D4C957F2D)) % U(shards)
    bits = key >> U(16)
    order = ordered(shard << U(48) | bits, 48 + (shards - 1).bit_length()) if shards <= 1 << 16 else np.lexsort((bits, shard))
    return order, bits[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=U))

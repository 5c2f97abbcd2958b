"""SimHash near-dedup by anchor points.

Fingerprints are grouped first, so that a text copied a million times is one point.
46 of the 64 bits are read as two words of the perfect binary Golay code of
length 23: every word lies within 3 bits of exactly one code word, its home. The pairs
of code words are the anchors. If two fingerprints differ in at most t bits, of
which i lie in the first and j in the second word, the second fingerprint lies within 3 + i
and 3 + j bits of the first one's anchor. So a fingerprint is laid at its home and at every
anchor it can reach with i + j <= t, and each fingerprint at home is compared with
what lies there. No pair is missed.

An anchor that is home to too many is cut up in the same way by a third word, of the perfect
Hamming code of length 15 (radius 1) over the next bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components, forest

WORDS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 2
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- fingerprints


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """text in parts of about `most` bytes, cut at white space."""
    at = 0
    while len(text) - at > most:
        m = SPACE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def shingle_hashes(text: str | None, n: int = SHINGLE, most: int = 1 << 22) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word n-grams of text, in parts; texts with fewer words hash whole."""
    carry: list[bytes] = []
    done = False
    for part in _parts((text or "").encode("utf-8", "surrogatepass").lower(), most):
        w = carry + part.split()
        if len(w) >= n:
            done = True
            norm = b" ".join(w)
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(w) - n] + 1])
            h = xxhash.xxh64_intdigest
            yield np.fromiter([h(norm[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64, len(starts))
            w = w[len(w) - n + 1 :]
        carry = w
    if not done and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _votes(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(text: str | None) -> int:
    votes, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        votes, total = votes + _votes(h).sum(0, dtype=np.int64), total + len(h)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.zeros(batch.num_rows, np.uint64)
        hashes: list[np.ndarray] = []
        rows: list[int] = []
        held = 0

        def settle(hashes=hashes, rows=rows, got=got) -> None:
            if not rows:
                return
            bits = _votes(np.concatenate(hashes))
            n = np.array([len(h) for h in hashes])
            votes = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int32)
            got[rows] = np.packbits(2 * votes > n[:, None], axis=1).view(">u8")[:, 0]
            hashes.clear()
            rows.clear()

        for k, text in enumerate(batch.column(1).to_pylist()):
            if text is not None and len(text) > 1 << 21:
                got[k] = fingerprint(text)
                continue
            for h in shingle_hashes(text):
                hashes.append(h)
                rows.append(k)
                held += len(h)
            if held > 1 << 17:
                settle()
                held = 0
        settle()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed bigint."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_fingerprints, f"id {d.schema['id'].dataType.simpleString()}, fp bigint")


# ---------------------------------------------------------------- anchors


def _remainders(values: np.ndarray, generator: int, length: int, data: int) -> np.ndarray:
    """Each value's remainder by a code's generator polynomial: 0 for code words."""
    r = values.copy()
    for bit in range(length - 1, length - data - 1, -1):
        r ^= np.where(r >> bit & 1, np.int64(generator << (bit - (length - data))), 0)
    return r


@cache
def _code(length: int, data: int, generator: int, radius: int, more: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The remainder of each word, and by remainder and cost c the flips that lead to a code word at distance radius + c (at most radius for c = 0)."""
    flips = [np.zeros(1, np.int64)]
    for w in range(1, radius + more + 1):
        last = flips[-1]
        top = np.where(last > 0, np.floor(np.log2(np.maximum(last, 1))).astype(np.int64), -1)
        flips.append(np.concatenate([last[top < b] | (1 << b) for b in range(length)]))
    half = length // 2  # remainders are linear: that of a word is that of its high bits, changed by that of its low bits
    high = _remainders(np.arange(1 << (length - half), dtype=np.int64) << half, generator, length, data).astype(np.int16)
    table = (high[:, None] ^ _remainders(np.arange(1 << half, dtype=np.int64), generator, length, data).astype(np.int16)).ravel()
    by_cost = []
    for c in range(more + 1):
        f = np.concatenate(flips[: radius + 1]) if c == 0 else flips[radius + c]
        s = table[f]
        order = np.argsort(s, kind="stable")
        f, s = f[order], s[order]
        n = np.bincount(s, minlength=1 << (length - data))
        padded = np.full((1 << (length - data), max(1, n.max())), -1, np.int64)
        padded[s, np.arange(len(s)) - (np.cumsum(n) - n)[s]] = f
        by_cost.append(padded)
    return table, by_cost


def golay(more: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code."""
    return _code(23, 12, 0b101011100011, 3, more)


def hamming(more: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fixed value: x^4 + x + 1 generates the Hamming code of length 15."""
    return _code(15, 11, 0b10011, 1, more)


def _home(fp: np.ndarray) -> np.ndarray:
    table, costs = golay(DISTANCE)
    a, b = fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF
    return (a ^ costs[0][table[a], 0]) << 23 | (b ^ costs[0][table[b], 0])


def _lay(fp: np.ndarray, hot: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor key, fingerprint, at home?) for every anchor that each fingerprint is laid at."""
    table, costs = golay(distance)
    a, b, c = fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF, fp >> 46 & 0x7FFF
    sa, sb = table[a], table[b]
    for i in range(distance + 1):
        for j in range(distance + 1 - i):
            fa, fb = costs[i][sa], costs[j][sb]
            row, x, y = np.nonzero((fa >= 0)[:, :, None] & (fb >= 0)[:, None, :])
            anchor, at, cost = (a[row] ^ fa[row, x]) << 23 | (b[row] ^ fb[row, y]), row, i + j
            cut_up = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
            plain = ~cut_up
            yield _key(anchor[plain], 0), fp[at[plain]], cost == 0
            if cut_up.any():
                t15, more = hamming(distance)
                anchor, at = anchor[cut_up], at[cut_up]
                for k in range(distance + 1 - cost):
                    fc = more[k][t15[c[at]]]
                    r, z = np.nonzero(fc >= 0)
                    yield _key(anchor[r], (c[at[r]] ^ fc[r, z]) + 1), fp[at[r]], cost + k == 0


def _key(anchor: np.ndarray, part) -> np.ndarray:
    return _mixed(anchor ^ (np.int64(part) if np.isscalar(part) else part) << 47) & ~np.int64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits (the finalizer of splitmix64); its lowest bit is given up for the home mark, so that two anchors in 2^63 share a key, which costs a comparison and no result."""
    with np.errstate(over="ignore"):
        u = x.astype(np.uint64)
        u = (u ^ u >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        u = (u ^ u >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (u ^ u >> np.uint64(31)).view(np.int64)


def near_pairs(key: np.ndarray, fp: np.ndarray, distance: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within `distance` bits of which the lower one is at home; key's lowest bit marks home."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    group = key & ~np.int64(1)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    of = np.repeat(np.arange(len(starts)), sizes)
    home = np.flatnonzero((key & 1 == 1) & (sizes[of] > 1))
    n = sizes[of[home]]
    upto = np.cumsum(n)
    at = 0
    while at < len(home):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        h, m = home[at:end], n[at:end]
        left = np.repeat(h, m)
        right = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[of[h]], m)
        x, y = fp[left], fp[right]
        near = (x < y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
        yield x[near], y[near]
        at = end


def links(fps: DataFrame, distance: int = DISTANCE, hot_share: int = 1 << 20, least_hot: int = 2048) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints in fps (one bigint column, fp) that connect all that differ in `distance` bits at most.

    Where many lie within reach of each other, a star of pairs stands for all of them. An anchor
    is cut up if it is home to more than least_hot fingerprints and to more than one in
    hot_share, so at most hot_share anchors are named to the executors.
    """
    total = fps.count()
    homes = fps.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(_home(b.column(0).to_numpy(zero_copy_only=False)))], ["home"]) for b in it), "home bigint")
    limit = max(least_hot, -(-total // hot_share))
    hot = homes.groupBy("home").count().where(F.col("count") > limit).select("home").toArrow()  # at most hot_share rows of 8 bytes
    hot = np.sort(hot.column("home").to_numpy())
    shards = max(256, total // 8192)

    def deal(batches):
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                keys, points = [], []
                for key, fp, home in _lay(all_fp[at : at + 4096], hot, distance):
                    keys.append(key | np.int64(home))
                    points.append(fp)
                key, fp = np.concatenate(keys), np.concatenate(points)
                shard = (key >> 1).view(np.uint64) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                key, fp, shard = key[order], fp[order], shard[order]
                starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                ends = np.append(starts[1:], len(shard))
                yield pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array([key[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()), pa.array([fp[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())], ["shard", "key", "fp"])

    def compare(t: pa.Table) -> pa.Table:
        both = [np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("key", "fp")]
        a = b = np.zeros(0, np.int64)
        for x, y in near_pairs(*both, distance):
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > 1 << 20:
                a, b = forest(a, b)
        a, b = forest(a, b)
        return pa.table({"a": a, "b": b})

    return fps.mapInArrow(deal, "shard int, key binary, fp binary").groupBy("shard").applyInArrow(compare, "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, kept.

    Null and empty texts, and texts without words, have fingerprint zero and are
    linked like any other. component_id is the smallest id that can be reached over links of at
    most `distance` bits; null ids never are the smallest unless they are
    alone. Repeated rows are returned as often as they occur. kept: the id is its component's.
    """
    f = cut(fingerprints(docs, id_col, text_col))
    points = cut(f.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(points.select("fp"), distance))
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id"))
    out = f.join(named, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, with one row of each component: that of the smallest id, null ids after all others, and of equal ids one with the least fingerprint and text."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def add(batches):
        for b in batches:
            fp = [x.column(1) for x in _fingerprints(iter([pa.RecordBatch.from_arrays([b.column(names.index(id_col)), b.column(names.index(text_col))], ["id", "text"])]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(fp) if fp else pa.array([], pa.int64())], [*names, "_fp"])

    rows = docs.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", `_fp` bigint")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    best = cut(rows.groupBy("_fp").agg(F.min_by(F.struct(*names), order).alias("_row")))
    points = best.select(F.col("_fp").alias("fp"), F.col("_row")[id_col].alias("least"))
    roots = components(links(points.select("fp")))
    linked = cut(points.join(roots, points["fp"] == roots["node"]).select("root", "fp", "least"))
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "fp")).alias("m")).select(F.col("m")["fp"].alias("fp"))
    gone = linked.join(first, "fp", "left_anti").select("fp")
    return best.join(gone, best["_fp"] == gone["fp"], "left_anti").select("_row.*")

"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Each of many tables sorts the vectors by one random projection, within cells that further
projections cut, so that a window of the sorted order holds few vectors whatever their
number. A pair collides in a table if both lie in one cell and within a window around each other.
Pairs with at least `least` collisions are verified by cosine in double precision. The number of tables is
the smallest that gives a pair right at the threshold the wanted recall.

Equal vectors are one point. A point goes to every table with its components, so a task can count a pair's collisions
in all tables by itself, and the first table in which they collide answers for the pair: no list of pairs is
made, only sums of links and a star of links for each connected set. A cell with very many points
is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import spread
from .common import cut, mix, small_batches
from .components import components, forest

COSINE, RECALL, LEAST, SEED = 0.95, 0.98, 2, 6
#: Points that a cell leaves to one task, and the cells that may be named to the executors: 16 bytes each.
CELL, HOT_CELLS = 8192, 1 << 20
U = np.uint64


@dataclass(frozen=True)
class Plan:
    tables: int
    cuts: int
    width: float
    window: float
    least: int

    def projections(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng([SEED, size])
        return r.standard_normal((size, self.tables * (self.cuts + 1))), r.random((self.tables, self.cuts)) * self.width

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell (with its table in it) and the place in its order, of each unit vector in each table."""
        a, shift = self.projections(x.shape[1])
        p = (x @ a).reshape(len(x), self.tables, self.cuts + 1)
        cell = np.floor((p[:, :, :-1] + shift) / self.width).astype(np.int64)
        key = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), cell.shape[:2]).copy() + U(x.shape[1] << 32)
        for k in range(self.cuts):
            key = mix(key * U(0x9E3779B97F4A7C15) + cell[:, :, k].view(np.uint64))
        return key, p[:, :, -1]


def plan(points: int, cosine: float = COSINE, recall: float = RECALL, least: int = LEAST) -> Plan:
    """Cuts so that a cell holds some dozens of points that lie anyhow, tables so that pairs at the threshold are found.

    Along a random direction the distance of a pair is normal with the deviation d, the pair's distance. A cell
    of width 4 d keeps it together with probability 1 - E|d| / 4 d = 0.80, a window of d with 0.68.
    """
    d = math.sqrt(max(1e-6, 2 - 2 * cosine))
    width = 4 * d
    alone = min(0.9, width / (2 * math.sqrt(math.pi)))  # that two points which lie anyhow share a cut
    cuts = max(1, math.ceil(math.log(max(2, points / 64)) / -math.log(alone)))
    p = (1 - math.sqrt(2 / math.pi) / 4) ** cuts * math.erf(1 / math.sqrt(2))
    tables, q = least, 1 - p
    while sum(math.comb(tables, k) * p**k * q ** (tables - k) for k in range(least)) > 1 - recall:
        tables += 1
    return Plan(tables, cuts, width, d, least)


def _unit(parts: list[bytes], kind: str, size: int) -> np.ndarray:
    """The unit vectors of parts that hold vectors of `size` bytes one after the other."""
    x = np.frombuffer(b"".join(parts), kind).reshape(-1, size // np.dtype(kind).itemsize).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(key: np.ndarray, block: np.ndarray, x: np.ndarray, table: np.ndarray, p: Plan, cosine: float, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs that this task answers for.

    key: what lies together. block: -1, or the half of a pair of blocks of which only pairs across count. About `most` numbers are held at once.
    """
    most = max(4096, most // p.tables)
    cells, values = p.keys(x)
    place = values[np.arange(len(x)), table]
    order = np.lexsort((place, key))
    k, v = key[order], place[order]
    # the window's end, by searching in one increasing sequence
    span = (v.max() - v.min() if len(v) else 0.0) + 2 * p.window + 1
    rank = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) * span
    end = np.searchsorted(rank + v, rank + v + p.window, "right")
    n = end - np.arange(len(v)) - 1
    upto = np.cumsum(n)
    at = 0
    while at < len(v):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        m = n[at:stop]
        left = np.repeat(np.arange(at, stop), m)
        right = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + left + 1
        i, j = order[left], order[right]
        ok = (block[i] < 0) | (block[i] != block[j])
        i, j = i[ok], j[ok]
        both = (cells[i] == cells[j]) & (np.abs(values[i] - values[j]) <= p.window)
        ok = (both.sum(1) >= p.least) & (both.argmax(1) == table[i])
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        yield i[ok], j[ok]
        at = stop


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and are their own
    component; so do vectors of a length that no other has. Repeated rows are linked with each other. component_id is the
    smallest id that can be reached; null ids count as links, and are a component's id only if it has no other.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    code = {"float": "<f4"}.get(kind, "<f8")
    v = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good, v).alias("v"))
    for seed in count():
        rows = rows.withColumn("point", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v", F.size("v"))))
        points = cut(rows.where("v is not null").groupBy("point", "v").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")))
        # a number stands for one vector: if two had the same, all would be numbered anew
        if points.groupBy("point").count().where("count > 1").isEmpty():
            break
    p = plan(points.count(), cosine, recall)

    def raw(column: pa.Array) -> list[bytes]:
        flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(code), (column.offsets.to_numpy() - column.offsets[0].as_py())
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def groups(b: pa.RecordBatch):
        """(positions, vectors as bytes, unit vectors) for each length of vector in a batch."""
        vec = raw(b.column(1))
        size = np.array([len(x) for x in vec])
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            for part in np.array_split(at, -(-len(at) // 1024)):
                mine = [vec[k] for k in part]
                yield part, mine, _unit(mine, code, int(s))

    def cells(batches):
        for b in batches:
            for _, _, x in groups(b):
                yield pa.RecordBatch.from_arrays([pa.array(p.keys(x)[0].ravel().view(np.int64))], ["cell"])

    d = points.select("point", "v", "times")
    counts = d.mapInArrow(cells, "cell bigint").groupBy("cell").count()
    total = points.count() * p.tables
    limit = max(CELL, -(-total // HOT_CELLS))
    hot = counts.where(F.col("count") > limit).select("cell", F.ceil(F.col("count") / limit).alias("blocks")).toArrow()  # HOT_CELLS rows at most
    shards = max(256, total // 8192)
    hot_keys, hot_blocks = hot.column("cell").to_numpy().view(np.uint64), hot.column("blocks").to_numpy()
    by_key = np.argsort(hot_keys)
    hot_keys, hot_blocks = hot_keys[by_key], hot_blocks[by_key].astype(np.int64)

    def deal(batches):
        for b in batches:
            ids, times = b.column(0).to_numpy(), b.column(2).to_numpy()
            for part, mine, x in groups(b):
                cell, _ = p.keys(x)
                n, t = cell.shape
                key, who, table = cell.ravel(), np.repeat(np.arange(n), t), np.tile(np.arange(t), n)
                block = np.full(len(key), -1, np.int64)
                if len(hot_keys) and (is_hot := np.isin(key, hot_keys)).any():
                    # a point of a hot cell goes to each pair of blocks that its own block is in
                    k = np.flatnonzero(is_hot)
                    many = hot_blocks[np.searchsorted(hot_keys, key[k])]
                    own = np.repeat((mix(ids[part[who[k]]].view(np.uint64) + U(1)) % many.astype(np.uint64)).astype(np.int64), many)
                    other, k = spread(np.zeros(len(k), np.int64), many), np.repeat(k, many)
                    many = np.repeat(many, many)
                    pair = mix(key[k] + (1 + np.minimum(own, other) * many + np.maximum(own, other)).view(np.uint64))
                    rest = np.flatnonzero(~is_hot)
                    key, at = np.concatenate([key[rest], pair]), np.concatenate([rest, k])
                    who, table, block = who[at], table[at], np.concatenate([block[rest], np.where(own == other, -1, own)])
                size = len(mine[0])
                shard = (mix(key ^ U(size)) % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                end = np.append(start[1:], len(shard))
                out = {"shard": shard[start].astype(np.int32), "size": np.full(len(start), size, np.int32)}
                for name, c in (("key", key.view(np.int64)), ("point", ids[part][who]), ("times", times[part][who]), ("tab", table), ("block", block)):
                    c = c[order]
                    out[name] = pa.array([c[s:e].tobytes() for s, e in zip(start, end, strict=True)], pa.binary())
                out["vec"] = pa.array([b"".join([mine[who[k]] for k in order[s:e]]) for s, e in zip(start, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    def compare(t: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "n": []}
        for size in np.unique(t.column("size").to_numpy()):
            mine = t.filter(pa.array(t.column("size").to_numpy() == size))
            key, point, times, table, block = (np.concatenate([np.frombuffer(x, np.int64) for x in mine.column(c).to_pylist()]) for c in ("key", "point", "times", "tab", "block"))
            x = _unit(mine.column("vec").to_pylist(), code, int(size))
            n = np.zeros(len(key), np.int64)
            a = b = np.zeros(0, np.int64)
            for i, j in linked(key, block, x, table, p, cosine):
                np.add.at(n, i, times[j])
                np.add.at(n, j, times[i])
                a, b = forest(np.concatenate([a, point[i]]), np.concatenate([b, point[j]]))
            some = np.flatnonzero(n)
            of, at = np.unique(point[some], return_inverse=True)
            out["a"] += [of, a]
            out["b"] += [of, b]
            out["n"] += [np.bincount(at, n[some], minlength=len(of)).astype(np.int64), np.zeros(len(a), np.int64)]
        return pa.table({k: np.concatenate(v).astype(np.int64) for k, v in out.items()})

    dealt = d.mapInArrow(deal, "shard int, size int, key binary, point binary, times binary, tab binary, block binary, vec binary")
    found = cut(dealt.groupBy("shard").applyInArrow(compare, "a bigint, b bigint, n bigint"))
    links = found.where("n > 0").groupBy(F.col("a").alias("p")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0"))
    named = points.select("point", "times", "least").join(roots, F.col("point") == F.col("node"), "left").join(links, F.col("point") == F.col("p"), "left")
    named = named.select("point", "least", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "point").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(ids, "root").select(F.col("point").alias("q"), "n_links", "component_id"))
    out = rows.select("vec_id", "point").join(named, F.col("point") == F.col("q"), "left")
    component = F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

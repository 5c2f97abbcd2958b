"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters, of order 5, over the chunks between white space: a chunk's first character follows four starts, its last is
followed by an end, and a chunk that repeats the one before is one character of its own, since prose hardly ever does so. Characters are taken as they are, in any script. Counts are summed up as sharded tables, and joined with the totals of
their histories order by order; the model is a table of discounted probabilities and of weights that histories give to the next lower order.

Documents are kept in blocks (see blocks.py), each as a bag of its different chunks. A block asks for the n-grams of its different chunks, shard by shard;
the shards meet the model's, and the block's chunks and documents are added up from what comes back. Nothing is broadcast.

A document is kept if its perplexity is not above a high quantile of those of its language's trusted documents, save the few that the model was
fitted on, which it knows too well. Short texts are drawn towards the trusted mean by as many symbols as `prior` says, so that a single rare word condemns none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, chunks, pack, pack_sorted, spread, unpack, unpack_sorted
from .common import cut, mix, placed
from .lm_scoring import discounts

#: Trusted documents that the model is fitted on at most: of every second one those of least hash.
MOST_TRUSTED = 20_000
ORDER = 5
QUANTILE = 0.995
#: The threshold lies this many bits a symbol above the quantile.
SLACK = 0.05
PRIOR = 100
#: Characters of a chunk that are taken at once; the next ones see the last four of them.
LONG = 4096
#: Symbols whose n-grams are made at once, shards of the model, and blocks that meet one copy of a shard.
STEP, SHARDS, MET = 1 << 20, 64, 64
START, END, AGAIN = "\0" * (ORDER - 1), " ", "\2"
U = np.uint64


def trusted(labels: DataFrame) -> DataFrame:
    """(trusted_id): the ids of quality 1; those without an id or label don't count."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()


def sample(ids: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Every second of the ids in trusted()'s result, chosen by hash, and at most `most`."""
    order = F.xxhash64("trusted_id")
    return ids.where(order % 2 == 0).orderBy(order, "trusted_id").limit(most)


def entries(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(each entry, as its place in the third; entries of each text; the different ones). An entry is four characters that come before, and characters to be told."""
    chunk, sizes, different = chunks(texts)
    again = np.zeros(len(chunk), bool)
    again[1:] = chunk[1:] == chunk[:-1]
    again[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    chunk = np.where(again, len(different), chunk)
    every = [*different, AGAIN] if again.any() else different
    out, n = [], np.ones(len(every), np.int64)
    for k, c in enumerate(every):
        c = c.replace("\0", "\1").replace(AGAIN, "\1") if k < len(different) and not c.isprintable() else c
        if len(c) <= LONG:
            out.append(START + c + END)
        else:
            whole = START + c + END
            parts = [whole[at : at + LONG + ORDER - 1] for at in range(0, len(c) + 1, LONG)]
            n[k] = len(parts)
            out += parts
    of = spread((np.cumsum(n) - n)[chunk], n[chunk])
    text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n[chunk])
    return of, np.bincount(text, minlength=len(sizes)), out


def keys(some: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For about STEP symbols of entries at a time: (which entries, told symbols of each, which of the different grams of order 5 each told symbol ends, gram[k - 1] and history[k - 1] of these for the orders k).

    Keys are hashes, even ones of grams, odd ones of histories.
    """
    at = 0
    size = np.fromiter(map(len, some), np.int64, len(some))
    upto = np.cumsum(size)
    power = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | U(1)
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        flat = np.frombuffer("".join(some[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        t = mix(flat + U(1))
        first = np.cumsum(size[at:end]) - size[at:end]
        told = np.ones(len(flat), bool)
        told[(first[:, None] + np.arange(ORDER - 1)).ravel()] = False
        told = np.flatnonzero(told)
        _, first, back = np.unique(sum(t[told - k] * power[k] for k in range(ORDER)), return_index=True, return_inverse=True)
        told = told[first]
        gram, history = np.zeros((2, ORDER, len(told)), np.uint64)
        g = h = np.zeros(len(told), np.uint64)
        for k in range(1, ORDER + 1):
            x = t[told - k + 1] * power[k - 1]
            g, h = g + x, h + x if k > 1 else h
            gram[k - 1], history[k - 1] = mix(g + U(2 * k)) & ~U(1), mix(h + U(2 * k + 1)) | U(1)
        yield slice(at, end), size[at:end] - ORDER + 1, back, gram, history
        at = end


def count(texts: DataFrame) -> DataFrame:
    """(g5, h5, ..., g1, h1, c): each gram of order 5 of the rows (text), its history, those of lower orders that end it, and how often it occurs."""
    names = [f"{x}{k}" for k in range(ORDER, 0, -1) for x in "gh"]

    def run(batches):
        for t in blocks(batches, 0):
            of, _, different = entries(t.column(0))
            often = np.bincount(of, minlength=len(different))
            for at, told, back, gram, history in keys(different):
                c = np.bincount(back, np.repeat(often[at], told), gram.shape[1]).astype(np.int64)
                columns = [x[k - 1].view(np.int64) for k in range(ORDER, 0, -1) for x in (gram, history)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(c)], [*names, "c"])

    rows = texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", c bigint")
    return rows.groupBy(*names).agg(F.sum("c").alias("c"))


def fit(texts: DataFrame) -> tuple[DataFrame, float]:
    """(table (key, v) of discounted probabilities of grams and of the weights of histories, probability of a symbol nobody has seen). Without text: an empty table, and 1."""
    table = cut(count(texts))
    out = None
    for k in range(ORDER, 0, -1):
        g, h = f"g{k}", f"h{k}"
        if k < ORDER:  # lower orders count how many symbols a gram follows
            table = cut(table.groupBy(*[f"{x}{j}" for j in range(k, 0, -1) for x in "gh"]).agg(F.count(F.lit(1)).alias("c")))
        n = table.where("c <= 4").groupBy("c").count().collect()  # four rows at most
        d = discounts([next((r["count"] for r in n if r.c == i), 0) for i in (1, 2, 3, 4)])
        t = table.withColumn("off", F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
        sums = (F.sum("c").alias("total"), F.sum("off").alias("given"), F.count(F.lit(1)).alias("n"))
        if k == 1:  # one history, the empty one
            every = t.agg(*sums).first()
            a = t.select(F.col(g).alias("key"), ((F.col("c") - F.col("off")) / F.lit(every.total)).cast("float").alias("v"))
            return cut(out.union(a)), every.given / every.total / (1 + every.n) if every.n else 1.0
        histories = cut(t.groupBy(h).agg(*sums))
        a = t.join(histories, h).select(F.col(g).alias("key"), ((F.col("c") - F.col("off")) / F.col("total")).cast("float").alias("v"))
        w = histories.select(F.col(h).alias("key"), (F.col("given") / F.col("total")).cast("float").alias("v"))
        out = a.union(w) if out is None else out.union(a).union(w)
    raise AssertionError


def read(docs: DataFrame, kind: str) -> DataFrame:
    """docs (id, text, lang) as rows (block, ids, langs, n, bag, entries): by document the sorted places of its entries, as differences, and how often each occurs."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for t in blocks(batches, 1):
            of, sizes, different = entries(t.column(1))
            row, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(different)) + of, return_counts=True)
            doc, entry = np.divmod(row, max(1, len(different)))
            n = np.bincount(doc, minlength=len(sizes))
            step = np.diff(entry, prepend=0)
            some = n > 0
            step[(np.cumsum(n) - n)[some]] = entry[(np.cumsum(n) - n)[some]]
            told = np.fromiter((len(x) - ORDER + 1 for x in different), np.int64, len(different))
            symbols = np.bincount(doc, often * told[entry], len(sizes)).astype(np.int64)
            text = "\n".join(different).encode("utf-8", "surrogatepass")
            lists = [pa.ListArray.from_arrays([0, len(sizes)], t.column(c).combine_chunks()) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([symbols]), pa.array([n]), pa.array([pack(step.astype(np.uint32))], pa.binary()), pa.array([pack(often.astype(np.uint32))], pa.binary()), pa.array([len(text)]), pa.array([pa.Codec("zstd").compress(text, asbytes=True)], pa.binary())], ["block", "ids", "langs", "symbols", "n", "steps", "often", "long", "entries"])
            block += 1

    return placed(docs.mapInArrow(run, f"block bigint, ids array<{kind}>, langs array<string>, symbols array<bigint>, n array<bigint>, steps binary, often binary, long bigint, entries binary"), "block")


def _entries(raw: bytes, long: int) -> list[str]:
    text = pa.Codec("zstd").decompress(raw, decompressed_size=long, asbytes=True).decode("utf-8", "surrogatepass") if long else ""
    return text.split("\n") if text else []


def _asked(some: list[str]) -> np.ndarray:
    """The different keys of entries, in order."""
    parts = [np.unique(np.concatenate([gram.ravel(), history[1:].ravel()])) for _, _, _, gram, history in keys(some)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def score(docs: DataFrame, model: DataFrame, unseen: float) -> DataFrame:
    """docs (id, text, lang) with bits, their loss under the model, and n_symbols, in place of text."""
    kind = docs.schema["id"].dataType.simpleString()
    b = read(docs, kind)
    rounds = max(1, -(-b.count() // MET))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = _asked(_entries(row["entries"], row["long"]))
                edges = np.searchsorted(key >> U(58), np.arange(SHARDS + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), (row["block"] + (row["block"] >> 32)) % rounds, np.int32)), pa.array(np.full(len(some), row["block"], np.int64)), pa.array([pack_sorted(key[edges[s] : edges[s + 1]]) for s in some], pa.binary())], ["shard", "copy", "block", "keys"])

    def tell(l: pa.Table, r: pa.Table) -> pa.Table:
        known, v = r.column("key").to_numpy().view(np.uint64), r.column("v").to_numpy()
        order = np.argsort(known)
        known, v = known[order], v[order]
        out = []
        for raw in l.column("keys").to_pylist():
            key = unpack_sorted(raw)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            # what the model does not have: a gram adds nothing, a history gives all to the lower order
            none = (key & U(1)).astype(np.float32)
            out.append(pack(np.where(known[at] == key, v[at], none) if len(known) else none))
        return pa.table({"block": l.column("block"), "shard": l.column("shard"), "v": pa.array(out, pa.binary())})

    asked = b.select("long", "entries", "block").mapInArrow(ask, "shard int, copy int, block bigint, keys binary")
    dealt = model.select(F.shiftrightunsigned("key", 58).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("copy"), "key", "v")
    told = asked.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInArrow(tell, "block bigint, shard int, v binary")

    def add(l: pa.Table, r: pa.Table) -> pa.Table:
        row = l.select(["n", "symbols", "steps", "often", "long", "entries"]).to_pylist()[0]
        different = _entries(row["entries"], row["long"])
        key = _asked(different)
        parts = [unpack(x, np.float32) for x in r.sort_by("shard").column("v").to_pylist()]
        v = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        loss = np.zeros(len(different))
        for at, size, back, gram, history in keys(different):
            p = v[np.searchsorted(key, gram[0])] + unseen
            for k in range(1, ORDER):
                p = v[np.searchsorted(key, gram[k])] + v[np.searchsorted(key, history[k])] * p
            loss[at] = np.bincount(np.repeat(np.arange(len(size)), size), -np.log2(p)[back], len(size))
        n, often = np.array(row["n"], np.int64), unpack(row["often"], np.uint32)
        doc = np.repeat(np.arange(len(n)), n)
        steps = np.cumsum(unpack(row["steps"], np.uint32).astype(np.int64))
        some = n > 0
        start = (np.cumsum(n) - n)[some]
        before = np.zeros(len(n), np.int64)
        before[some] = np.concatenate([[0], steps[start[1:] - 1]]) if len(start) else 0
        entry = steps - before[doc]
        return pa.table({"id": l.column("ids").combine_chunks().flatten(), "lang": l.column("langs").combine_chunks().flatten(), "n_symbols": pa.array(row["symbols"], pa.int64()), "bits": np.bincount(doc, often * loss[entry], len(n)).astype(np.float64)})

    return b.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add, f"id {kind}, lang string, n_symbols bigint, bits double")


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_TRUSTED, quantile: float = QUANTILE, slack: float = SLACK, prior: int = PRIOR) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_symbols, perplexity, threshold, kept.

    Null and empty texts, and those of white space, have no perplexity and are not kept. A language without trusted
    documents, and a null one, has the mean and threshold of all trusted documents together; if there are none but the fitted ones, all with
    text are kept. Ties with the threshold are kept. Repeated rows are scored each.
    """
    ids = trusted(labels)
    few = F.broadcast(cut(sample(ids, most)))  # `most` ids at most
    d = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    model, unseen = fit(d.join(few, F.col("id") == F.col("trusted_id")).select("text"))
    # means and limits are over all other trusted documents: labels grow with the corpus, so the join is a merge whatever their size
    others = ids.join(few.withColumnRenamed("trusted_id", "_fitted"), F.col("trusted_id") == F.col("_fitted"), "left_anti")
    s = score(d, model, unseen).join(others.hint("merge"), F.col("id") == F.col("trusted_id"), "left")
    s = cut(s.withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id"))
    good = s.where("trusted and n_symbols > 0")
    mean = (F.sum("bits") / F.sum("n_symbols")).alias("mean")
    every = good.agg(mean).first().mean or 0.0
    means = F.broadcast(good.where("lang is not null").groupBy("lang").agg(mean))  # a row for each language
    loss = (F.col("bits") + prior * F.coalesce("mean", F.lit(every))) / (F.col("n_symbols") + prior)
    s = s.join(means, "lang", "left").withColumn("loss", loss)
    limits = s.where("trusted and n_symbols > 0")
    high = (F.percentile_approx("loss", quantile, 10_000) + slack).alias("high")
    all_of = limits.agg(high).first().high
    by = F.broadcast(limits.where("lang is not null").groupBy("lang").agg(high))
    out = s.join(by, "lang", "left").withColumn("high", F.coalesce("high", F.lit(all_of).cast("double")))
    some = F.col("n_symbols") > 0
    power = lambda c: F.pow(F.lit(2.0), c)
    return out.select(F.col("id").alias("doc_id"), "lang", "n_symbols", F.when(some, power("loss")).alias("perplexity"), power("high").alias("threshold"), (some & F.coalesce(F.col("loss") <= F.col("high"), F.lit(True))).alias("kept"))

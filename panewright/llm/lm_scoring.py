"""LM scoring by cross-entropy difference.

Three interpolated modified Kneser-Ney models of word pairs share one vocabulary, that of all documents: the target model has the documents
labelled good, the background model as many words of documents drawn by hash from all, and the corpus model all documents. A document's
score is its loss a symbol under the target model less that under the background model: the lower, the more it is like the target. Each document is
scored with its own counts taken out, so that those a model was fitted on are judged like others.

Symbols are words, digits, marks, single ideographs and kana, and the end of a text. Texts are kept in blocks (see blocks.py), which lie where their number says
and are not moved again. Of each block the different pairs go to the shards that add them up, and the sums come back; then the same for words, as histories and as followers.
What is shuffled grows with the corpus; nothing is broadcast or cut off. A pair or word is known by 48 bits of a hash and its shard.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, by_shard, ordered, pack, pack_sorted, unpack, unpack_sorted
from .common import cut, mix, placed

#: What goes on as one symbol; any other character but white space is one of its own.
WORDS = regex.compile(r"[[\p{L}\p{M}]--[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]]+", regex.V1)
SPACE, WORD, SINGLE = range(3)
MODELS = ("target", "background", "corpus")
U = np.uint64
#: Symbols of the corpus for each shard that counts.
SHARD = 1 << 22
#: Symbols of a block that are scored in one go, whole documents at a time.
SCORED = 1 << 18
#: Characters that are cut into symbols in one go, two at least.
PIECE = 1 << 20


def targets(labels: DataFrame) -> DataFrame:
    """(target_id): the documents of quality 1 that are not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("target_id")).distinct()


@cache
def kinds() -> np.ndarray:
    """SPACE, WORD or SINGLE for each code point."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kind = np.full(len(every), SINGLE, np.uint8)
    for what, found in ((WORD, WORDS), (SPACE, regex.compile(r"[\s\x1C-\x1F]+"))):
        for m in found.finditer(every):
            kind[slice(*m.span())] = what
    return kind


def pieces(texts: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """(the symbols of texts in lower case, in arrays one after the other; how many each text has)."""
    ends, text = np.cumsum([len(t) for t in texts]), "".join(texts)
    out, n = [], np.zeros(len(texts), np.int64)
    at, codes = 0, lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    while at < len(text):
        code = codes(text[at : at + PIECE])
        kind = kinds()[code]
        some, word = kind != SPACE, kind == WORD
        begins = some.copy()
        begins[1:] &= ~(word[1:] & word[:-1])
        first = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(code))] - at
        begins[first] = some[first]
        del kind, word
        size = len(code)
        if at + size < len(text):  # the last symbol may go on: it is left for the next piece
            ended = (begins | ~some)[:0:-1]
            if not ended.any():  # all one word: only its end is looked for
                of = int(np.searchsorted(ends, at, "right"))
                to, last = at + size, int(ends[of])
                while to < last and (word := kinds()[codes(text[to : min(to + PIECE, last)])] == WORD)[0]:
                    to += len(word) if word.all() else int(word.argmin())
                out.append(pa.array([text[at:to]], pa.large_string()))
                n[of] += 1
                at = to
                continue
            size -= 1 + int(ended.argmax())
            del ended
        code, begins = code[:size][some[:size]], begins[:size]
        n += np.diff(np.searchsorted(np.flatnonzero(begins), np.clip(ends - at, 0, size)), prepend=0)
        start = np.flatnonzero(begins[some[:size]])
        raw = str(code, "utf-32-le").encode()
        if len(raw) > len(code):
            wide = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            start = (np.cumsum(wide) - wide)[start]
        out.append(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw))), pa.py_buffer(raw)))
        at += size
    return out, n


def symbols(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(each symbol, as its place in the third; symbols of each text; the different ones, most frequent first). The end of a text is the symbol ""; texts without others have no end."""
    found, of = [], [np.zeros(0, np.int64)]
    for t in blocks(pa.table([texts], ["text"]).to_batches(), 0, PIECE):
        some, n = pieces([(x or "").lower() for x in t.column(0).to_pylist()])
        found += some
        of.append(n)
    of = np.concatenate(of)
    got = pa.chunked_array(found, pa.large_string()).combine_chunks().dictionary_encode()
    del found
    names = ["", *got.dictionary.to_pylist()]
    seq = np.insert(got.indices.to_numpy().astype(np.int64) + 1, np.cumsum(of)[of > 0], 0)
    count = np.bincount(seq, minlength=len(names))
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return place[seq], of + (of > 0), [names[k] for k in order]


def read(docs: DataFrame, kind: str) -> DataFrame:
    """docs (id, text, luck) as rows (block, ids, n, luck, seq, words): symbols by block."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for t in blocks(batches, 1):
            seq, n, names = symbols(t.column(1))
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
            ids, luck = t.column(0).combine_chunks(), t.column(2).to_numpy().astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([n.astype(np.int64)]), pa.array([pack(luck)], pa.binary()), pa.array([pack(seq.astype(np.uint32))], pa.binary()), pa.array([words.tobytes()], pa.binary())], ["block", "ids", "n", "luck", "seq", "words"])
            at += 1

    return placed(docs.mapInArrow(run, f"block bigint, ids array<{kind}>, n array<bigint>, luck binary, seq binary, words binary"), "block")


class Block:
    """The pairs of a block, from a row of read() with `at`, the places of its target documents."""

    def __init__(self, row: dict, rate: float, shards: int) -> None:
        self.n = np.array(row["n"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.v = len(self.words)
        w = unpack(row["seq"], np.uint32).astype(np.int64)
        end = int(w[-1]) if len(w) else 0  # a text's end stands before the next text
        pair = np.concatenate([[end], w[:-1]]) * self.v + w if len(w) else w
        del w
        order = ordered(pair, (self.v**2).bit_length()) if self.v < 1 << 31 else np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
        #: the different pairs, and which of them each symbol makes with the one before
        self.pairs, self.of = pair[new], np.empty(len(pair), np.int32)
        del pair
        self.of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order, new
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.h, self.w = np.divmod(self.pairs, max(1, self.v))
        target = np.zeros(len(self.n), bool)
        target[np.array(row["at"] or [], np.int64)] = True
        #: for each model, whether it has the document
        self.has = [target, unpack(row["luck"], np.uint32) < rate * 2**32, np.ones(len(self.n), bool)]
        self.order, self.keys, self.edges = by_shard(mix(self.words[self.h] * U(0x9E3779B97F4A7C15) + mix(self.words[self.w])), shards)
        self.word_order, self.word_keys, self.word_edges = by_shard(self.words, shards)

    @property
    def counts(self) -> list[np.ndarray]:
        """How often each model's documents have each pair."""
        return [np.bincount(self.of if has.all() else self.of[has[self.doc]], minlength=len(self.pairs)).astype(np.uint64) for has in self.has]

    def sums(self, answers: list[bytes], order: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The numbers that came back for each key, a row for each kind of number, in the block's own order."""
        parts = [unpack(a, np.uint64).reshape(-1, e - s) for a, s, e in zip(answers, edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0], strict=True)]
        got = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.uint64)
        out = np.empty((len(got), len(order)), np.int64)
        for to, numbers in zip(out, got, strict=True):
            to[order] = numbers
        return out


def ask(block: int, keys: np.ndarray, edges: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """Rows (shard, block, keys, numbers) of the shards that have keys."""
    some = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[s], edges[s + 1]) for s in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block, np.int64)), pa.array([pack_sorted(keys[p]) for p in parts], pa.binary()), pa.array([pack(numbers[:, p].ravel()) for p in parts], pa.binary())], ["shard", "block", "keys", "numbers"])


ASKED = "shard int, block bigint, keys binary, numbers binary"


def _buckets(sums: np.ndarray) -> list[int]:
    """How many of a model's numbers are 1, 2, 3, 4, over 0, and their sum."""
    return [*(int((sums == k).sum()) for k in (1, 2, 3, 4)), int((sums > 0).sum()), int(sums.sum())]


def answer(asked: DataFrame, models: slice, first: bool) -> tuple[DataFrame, list[list[int]]]:
    """(rows (block, shard, numbers) with the sums over all blocks in the order that was asked, for each model its _buckets and in the end the number of keys).

    models: which numbers the buckets are of. first: one more number says whether the block is the first that asks for the key.
    """

    def add(t: pa.Table) -> pa.Table:
        parts = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
        size = [len(p) for p in parts]
        key = np.concatenate(parts)
        order = ordered(key, 48)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        numbers = np.concatenate([unpack(x, np.uint64).reshape(-1, n) for x, n in zip(t.column("numbers").to_pylist(), size, strict=True)], 1)
        sums = [np.add.reduceat(m[order], start) for m in numbers]
        back = np.empty((len(numbers) + first, len(key)), np.uint64)
        for to, m in zip(back, sums, strict=False):
            to[order] = m[group]
        if first:
            back[-1, order] = new
        cuts = np.cumsum([0, *size])
        stats = [x for m in sums[models] for x in _buckets(m)] + [len(start)]
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "numbers": pa.array([pack(back[:, a:b].ravel()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "stats": pa.array([stats, *[None] * (len(size) - 1)], pa.list_(pa.int64()))})

    got = cut(asked.groupBy("shard").applyInArrow(add, "block bigint, shard int, numbers binary, stats array<bigint>"))
    stats = got.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(f"s{k}") for k in range(6 * len(MODELS) + 1)]).first()
    return got.drop("stats"), [[stats[6 * m + k] for k in range(6)] for m in range(len(MODELS))] + [[stats[-1]]]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of grams seen once, twice, three and four times; where these say nothing, a half, one and one and a half."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))  # type: ignore[return-value]


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _grouped(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal keys in it, group of each in it); keys are below most."""
    order = ordered(key, most.bit_length())
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def losses(b: Block, pairs: np.ndarray, words: np.ndarray, pair_off: list[tuple], word_off: list[tuple], word_stats: list[list[int]], size: int) -> np.ndarray:
    """Bits of each document under each model, without the document's own counts."""
    upto = np.concatenate([[0], np.cumsum(b.n)])
    out, at = np.zeros((len(MODELS), len(b.n))), 0
    while at < len(b.n):  # what is held for each symbol is many times its size, so not for the whole block at once
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + SCORED, "right")) - 1)
        if upto[end] > upto[at]:
            out[:, at:end] = _losses(b, at, end, slice(upto[at], upto[end]), pairs, words, pair_off, word_off, word_stats, size)
        at = end
    return out


def _losses(b: Block, first: int, last: int, symbols: slice, pairs: np.ndarray, words: np.ndarray, pair_off: list[tuple], word_off: list[tuple], word_stats: list[list[int]], size: int) -> np.ndarray:
    """losses() of the documents from first to before last, which have these symbols, one at least."""
    row, x = np.unique(b.doc[symbols].astype(np.int64) * len(b.pairs) + b.of[symbols], return_counts=True)
    doc, pair = np.divmod(row, len(b.pairs))
    h, w = b.h[pair], b.w[pair]
    out = np.zeros((len(MODELS), last - first))
    # rows are sorted by document, history and word
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    start, of = np.flatnonzero(new), np.cumsum(new) - 1
    order, followed, follower = _grouped((doc - first) * b.v + w, (last - first) * b.v)
    for m in range(len(MODELS)):
        own = b.has[m][doc]
        c = pairs[m][pair]
        left = c - np.where(own, x, 0)
        total = words[m][h] - np.add.reduceat(np.where(own, x, 0), start)[of]
        given = np.zeros(len(row))
        for k in (1, 2, 3):
            change = (np.minimum(left, 3) == k).astype(np.int64) - (np.minimum(c, 3) == k)
            given += pair_off[m][k - 1] * (words[3 + 3 * m + k - 1][h] + np.add.reduceat(change, start)[of])
        gone = ((c > 0) & (left == 0)).astype(np.int64)
        after = np.empty(len(row), np.int64)
        after[order] = np.add.reduceat(gone[order], followed)[follower]
        follows = words[12 + m][w] - after
        ones, twos, _, _, some, every = word_stats[m]
        d = word_off[m]
        spare = d[0] * ones + d[1] * twos + d[2] * (some - ones - twos)
        low = (follows - _off(follows, d) + spare / size) / every if every else np.full(len(row), 1.0 / size)
        p = np.where(total > 0, (left - _off(left, pair_off[m]) + given * low) / np.maximum(total, 1), low)
        out[m] = np.bincount(doc - first, -x * np.log2(p), last - first)
    return out


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_symbols, target_loss, background_loss, corpus_loss, score, in bits a symbol.

    Null and empty texts, and those of white space, have no symbols and null losses and score. Repeated rows count as often as they occur, in all models, and only
    one's own row is taken out when it is scored. Further columns are not read. Without target documents the target and the background model are uniform over the vocabulary, and all scores are 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    b = read(docs.select(F.col("doc_id").alias("id"), "text", luck.alias("luck")), kind)
    each = b.select("block", F.posexplode(F.arrays_zip("ids", "n")).alias("at", "d")).select("block", "at", F.col("d")["ids"].alias("id"), F.col("d")["n"].alias("n"))
    # a merge join whatever the tables' sizes: labels grow with the corpus, and a plan that changes with size is one that was never tried
    good = cut(each.join(targets(labels).hint("merge"), F.col("id") == F.col("target_id")).select("block", "at", "n"))
    every, mine = (d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for d in (each, good))
    rate = mine / every if every else 0.0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), every // SHARD)
    known = b.join(good.groupBy("block").agg(F.collect_list("at").alias("at")), "block", "left")

    def ask_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Block(row, rate, shards)
                yield ask(row["block"], x.keys, x.edges, np.stack([c[x.order] for c in x.counts]))

    def ask_words(l: pa.Table, r: pa.Table) -> pa.Table:
        row = l.to_pylist()[0]
        x = Block(row, rate, shards)
        *sums, first = x.sums(r.sort_by("shard").column("numbers").to_pylist(), x.order, x.edges)
        add = lambda at, what: np.bincount(at, what, x.v).astype(np.uint64)
        numbers = [add(x.h, c) for c in x.counts]
        numbers += [add(x.h, (first == 1) & ((c == k) if k < 3 else (c >= 3))) for c in sums for k in (1, 2, 3)]
        numbers += [add(x.w, (first == 1) & (c > 0)) for c in sums]
        return pa.Table.from_batches([ask(row["block"], x.word_keys, x.word_edges, np.stack([c[x.word_order] for c in numbers]))])

    pairs, pair_stats = answer(known.select("block", "n", "luck", "seq", "words", "at").mapInArrow(ask_pairs, ASKED), slice(0, 3), True)
    asked = known.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(ask_words, ASKED)
    words, word_stats = answer(asked, slice(12, 15), False)
    pair_off, word_off = ([discounts(s[:4]) for s in stats[:-1]] for stats in (pair_stats, word_stats))
    size = max(1, word_stats[-1][0])

    def score(l: pa.Table, r: pa.Table) -> pa.Table:
        row = l.select(["n", "luck", "seq", "words", "at"]).to_pylist()[0]
        x = Block(row, rate, shards)
        r = r.sort_by("shard")
        got = [r.filter(pa.array(r.column("kind").to_numpy() == k)).column("numbers").to_pylist() for k in (0, 1)]
        bits = losses(x, x.sums(got[0], x.order, x.edges), x.sums(got[1], x.word_order, x.word_edges), pair_off, word_off, word_stats, size)
        some = x.n > 0
        loss = bits / np.maximum(x.n, 1)
        null = lambda a: pa.array(a, mask=~some)
        return pa.table([l.column("ids").combine_chunks().flatten(), pa.array(x.n), *[null(a) for a in loss], null(loss[0] - loss[1])], ["doc_id", "n_symbols", *[f"{m}_loss" for m in MODELS], "score"])

    both = pairs.withColumn("kind", F.lit(0)).unionByName(words.withColumn("kind", F.lit(1)))
    kinds = ", ".join(f"{c} double" for c in (*[f"{m}_loss" for m in MODELS], "score"))
    return known.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_symbols bigint, {kinds}")

"""Substring dedup: MinHash banding over lines, and over pieces that the text itself cuts.

Paragraphs are of two kinds. Each line of five words or more is one. A passage that was copied into another text may
start and end in the middle of a line, so the text is also cut into pieces, which run from one word pair that has the least
hash within four words of it to the next such pair. Where a piece is cut depends on these words alone, and a
copied passage has the same cuts within it wherever it stands. Lines are compared with lines, pieces with pieces.

1. Each paragraph's 5-word shingles give a minimum for each band. Tasks send each band's key once for each content
   that has it, and learn which keys occur elsewhere, and which do in another content: nearly all paragraphs share none and are done.
2. The others come again. Equal ones are one content. Different ones that share a band's key come with their shingles and are compared; pairs with a
   Jaccard similarity of 0.8 are links; linked contents are clusters. One occurrence of a cluster stays.
3. Neighbouring pieces of a document form a run. Runs of fewer than 12 words are chance, and are left alone; lines are not.
4. A piece that says no more than the line around it is not named.

A content is known by 64 bits of the hashes of its shingles; whether two contents of one key differ is seen by 24 of them, and shingles are compared by 40 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, pack_sorted, spread, unpack, unpack_sorted
from .common import cut, mix, small_batches
from .components import components, forest

SHINGLE, REACH, LONGEST = 5, 4, 64
#: At similarity 0.8 a pair shares one of 3 bands of 1 with probability 1 - (1 - 0.8)^3 = 0.992. Texts that differ share
#: hardly any five words in a row, so wider bands would save no comparisons, and for that recall need twice as many keys.
BANDS, ROWS = 3, 1
SIMILAR, LEAST_WORDS = 0.8, 12
BLOCK = 1 << 20
U = np.uint64
#: Makes the shingles of lines other numbers than those of pieces.
LINE = U(0xA24BAED4963EE407)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 0x9E3779B97F4A7C15
    up, down = np.full(n, U(p)), np.full(n, U(pow(p, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mix(np.arange(1, 257, dtype=np.uint64)) | U(1)


_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of all texts, the number of words of each text, and which words begin a line; white space is that of ASCII."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = 1 << max(16, int(len(flat)).bit_length())
    up, down, letters = _powers(size)
    gap = _IS_SPACE[flat]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([[U(0)], np.cumsum(letters[flat] * up[: len(flat)])])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    line = np.cumsum((flat == 10) | (flat == 13))[start]  # a text's end counts as a line end
    return h, np.diff(np.concatenate([[0], upto])), np.concatenate([[True], line[1:] != line[:-1]])[: len(h)]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and the number of words of each text."""
    return _words(texts)[:2]


def _begins(w: np.ndarray, text: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The words at which pieces begin. context: words of each text that only stand before the first piece."""
    n = len(w)
    pair = mix(w + np.append(w[1:], U(0)) * U(0xD6E8FEB86659FD93))
    pair[np.concatenate([np.flatnonzero(text[1:] != text[:-1]), [n - 1]])] = U(2**64 - 1)  # a text's last word has no pair
    place = np.arange(n) + (text + 1) * REACH  # as many words of no text before, between and after texts
    padded = np.full(n + (len(context) + 1) * REACH, U(2**64 - 1))
    padded[place] = pair
    least = np.lib.stride_tricks.sliding_window_view(padded, REACH)
    before, after = least[place - REACH].min(1), least[np.minimum(place + 1, len(least) - 1)].min(1)
    begins = (pair < before) & (pair <= after)
    start = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
    begins[start] = True
    forced = start + context[text[start]]
    begins[forced[forced < np.append(start[1:], n)]] = True
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, n))
    if (length > LONGEST).any():  # nothing to tell one place from another, as in one word repeated
        more = [np.arange(a, a + m, LONGEST) for a, m in zip(first[length > LONGEST], length[length > LONGEST], strict=True)]
        first = np.union1d(first, np.concatenate(more))
    return first


@dataclass(frozen=True)
class Part:
    """Of a long text: words that only stand before the first piece, words whose lines were told before, and the word from which pieces are left to the next part."""

    context: int = 0
    told: int = 0
    stop: int = 1 << 62


class Paragraphs:
    """The paragraphs of some texts, pieces before lines: text, first word in its text, words, whether a line, shingles (of all, with the first of each) and content."""

    def __init__(self, texts: list[bytes], parts: list[Part] | None = None) -> None:
        w, sizes, begins_line = _words(texts)
        n = len(w)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.text = self.first = self.words = np.zeros(0, np.int64)
        self.line = np.zeros(0, bool)
        self.shingles, self.at, self.content = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < SHINGLE:
            return
        context, told, stop = (np.array([getattr(p, k) for p in parts or [Part()] * len(texts)], np.int64) for k in ("context", "told", "stop"))
        start = np.cumsum(sizes) - sizes
        rest = (told > 0) & (told < sizes)
        begins_line[(start + told)[rest]] = True
        first, whole = _begins(w, text, context), np.flatnonzero(begins_line)
        length, of_line = np.diff(np.append(first, n)), np.diff(np.append(whole, n))
        mine = lambda at: at - start[text[at]]
        piece = (mine(first) >= context[text[first]]) & (mine(first) < stop[text[first]])
        fresh = mine(whole) >= told[text[whole]]
        self.line = np.repeat([False, True], [piece.sum(), fresh.sum()])
        first, length = np.concatenate([first[piece], whole[fresh]]), np.concatenate([length[piece], of_line[fresh]])
        keep = length >= SHINGLE
        first, length, self.line = first[keep], length[keep], self.line[keep]
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for k, power in enumerate(mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | U(1)):
            s += w[k : n - SHINGLE + 1 + k] * power
        s = mix(s)
        m = length - SHINGLE + 1
        at = np.cumsum(m) - m
        self.text, self.words, self.at = text[first], length, at
        self.shingles = s[spread(first, m)] ^ np.where(np.repeat(self.line, m), LINE, U(0))
        self.first = first - start[self.text]
        self.content = mix(np.add.reduceat(mix(self.shingles), at) + length.astype(np.uint64)) if len(at) else self.content

    def code(self, skip: np.ndarray) -> np.ndarray:
        """Twice the first word, counted with the words before the part, and one more for a line."""
        return 2 * (self.first + skip[self.text]) + self.line

    def bands(self) -> np.ndarray:
        """BANDS keys for each paragraph."""
        keys = np.zeros((BANDS, len(self.at)), np.uint64)
        for b in range(BANDS):
            key = np.full(len(self.at), U(b + 1))
            for r in range(ROWS):
                least = np.minimum.reduceat(mix(self.shingles * U(0xE7037ED1A0B428DB) + U(b * ROWS + r + 1)), self.at) if len(self.at) else key
                key = mix(key * U(0x8EBC6AF09C88C6E3) + least)
            keys[b] = key
        return keys


def _long(text: bytes, most: int) -> Iterator[tuple[int, bytes, Part]]:
    """(words before, bytes, what to tell of them) of a long text in parts of about `most` bytes, cut at line ends, or else at white space.

    A part begins with the last words of the one before, from its last piece on whose beginning is sure, so pieces are those of the whole text. A line that is longer than a part is told part by part.
    """
    at, before, carried, part = 0, 0, b"", Part()
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            raw = np.frombuffer(text[at:end], np.uint8)
            space = np.flatnonzero(raw == 10)
            space = space if len(space) else np.flatnonzero(_IS_SPACE[raw])
            end = at + int(space[-1]) + 1 if len(space) else end
        raw, at = carried + text[at:end], end
        if at == len(text):
            yield before, raw, part
            return
        w, sizes, _ = _words([raw])
        n = len(w)
        sure = _begins(w, np.zeros(n, np.int64), np.array([part.context])) if n else np.zeros(0, np.int64)
        sure = sure[(sure > part.context) & (sure <= n - REACH - 2)]
        stop = int(sure[-1]) if len(sure) else n
        yield before, raw, Part(part.context, part.told, stop)
        context = min(REACH, stop)
        edge = np.diff(np.concatenate([[True], _IS_SPACE[np.frombuffer(raw, np.uint8)]]).astype(np.int8))
        begin = np.append(np.flatnonzero(edge == -1), len(raw))
        carried = raw[begin[stop - context] :]
        before += stop - context
        part = Part(context, n - stop + context)


def blocks(ids: list[int], texts: list[str | None], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list[Part]]]:
    """(id, number of words before, text, what to tell of it) of about BLOCK bytes; longer texts come in parts."""
    most = most or 2 * BLOCK
    row, skip, held, parts, size = [], [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        for before, raw, part in _long(b, most) if len(b) > most else [(0, b, Part())] if b else []:
            row.append(i)
            skip.append(before)
            held.append(raw)
            parts.append(part)
            size += len(raw)
            if size >= min(BLOCK, most):
                yield np.array(row), np.array(skip), held, parts
                row, skip, held, parts, size = [], [], [], [], 0
    if row:
        yield np.array(row), np.array(skip), held, parts


def _unique(doc: np.ndarray, code: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 8 * code + bands in doubt) of the different (doc, code)."""
    order = np.lexsort((code, doc))
    doc, code, doubt = doc[order], code[order], doubt[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    if not len(doc):
        return doc, code
    return doc[new], 8 * code[new] + np.bitwise_or.reduceat(doubt, np.flatnonzero(new))


def _groups(order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each row, in order, is the first with its values of columns; how many have them)."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    return new, np.repeat(size, size)


def suspects(docs: DataFrame, shards: int, held: int = 1 << 21) -> DataFrame:
    """(doc_id, code): the paragraphs that share a band's key with another; some twice. code: 8 * Paragraphs.code + the bands, a bit each, by which the content must be compared with others.

    docs: doc_id, text. In every `held` entries a task sends each key once for each content, with a paragraph that has it, and names the others that share it.
    """

    def rows(shard, doc, code, **more):
        order = np.argsort(shard, kind="stable")
        start = np.flatnonzero(np.diff(shard[order], prepend=-(1 << 40)))
        parts = [order[a:b] for a, b in zip(start, np.append(start[1:], len(order)), strict=True)]
        bare = [pa.array([pack(c[p]) for p in parts], pa.binary()) for c in (doc, code)]
        rest = [pa.array([f(c[p]) for p in parts], pa.binary()) for f, c in more.values()] or [pa.nulls(len(parts), pa.binary())] * 2
        return pa.RecordBatch.from_arrays([pa.array(shard[order][start].astype(np.int32)), *bare, *rest], ["shard", "doc", "code", "key", "kind"])

    def send(batches):
        keys, docs_, codes, kinds, n = [], [], [], [], 0

        def flush():
            key, doc, code, kind = map(np.concatenate, (keys, docs_, codes, kinds))
            order = np.lexsort((code, doc, kind, key))
            key, doc, code, kind = key[order], doc[order], code[order], kind[order]
            same = np.arange(len(key))
            new, alike = _groups(same, key)
            first, equal = _groups(same, key, kind)
            shared = alike > 1
            own_doc, own = _unique(doc[shared], code[shared] >> 2, np.where(first & (equal < alike), 1 << (code & 3), 0)[shared])
            if len(own):  # shards below 0 hold what is named already
                yield rows(-1 - (mix(own_doc.view(np.uint64)) % U(shards)).astype(np.int64), own_doc, own)
            key, doc, code, kind = key[first], doc[first], code[first], kind[first]
            # half a key is enough within a shard: two that agree by chance only are compared for nothing
            yield rows((key % U(shards)).astype(np.int64), doc, code, key=(pack_sorted, key >> U(32)), kind=(pack, kind))

        for b in batches:
            for row, skip, texts, parts in blocks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Paragraphs(texts, parts)
                code = p.code(skip)
                for k, key in enumerate(p.bands()):
                    keys.append(key)
                    docs_.append(row[p.text])
                    codes.append(4 * code + k)
                    kinds.append((p.content >> U(40)).astype(np.uint32))
                n += BANDS * len(code)
                if n >= held:
                    yield from flush()
                    keys, docs_, codes, kinds, n = [], [], [], [], 0
        if n:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        doc, code = (np.concatenate([unpack(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("doc", "code"))
        if t.column("shard")[0].as_py() >= 0:
            key = np.concatenate([unpack_sorted(x) for x in t.column("key").to_pylist()])
            kind = np.concatenate([unpack(x, np.uint32) for x in t.column("kind").to_pylist()])
            order = np.lexsort((code, doc, kind, key))
            _, alike = _groups(order, key)
            first, equal = _groups(order, key, kind)
            shared, doubt = alike > 1, np.where(first & (equal < alike), 1 << (code[order] & 3), 0)
            doc, code = _unique(doc[order][shared], code[order][shared] >> 2, doubt[shared])
        return pa.table({"doc_id": doc, "code": code})

    sent = docs.select("doc_id", "text").mapInArrow(send, "shard int, doc binary, code binary, key binary, kind binary")
    return sent.groupBy("shard").applyInArrow(meet, "doc_id bigint, code bigint")


#: Contents of one key that are compared in one go; of more, blocks are compared with blocks.
TOGETHER = 4096


def _shingles(raw: list[bytes]) -> list[np.ndarray]:
    flat = np.zeros((sum(map(len, raw)) // 5, 8), np.uint8)
    flat[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
    return np.split(flat.view(np.uint64)[:, 0], np.cumsum([len(x) // 5 for x in raw])[:-1])


def similar(contents: DataFrame, shards: int, least: float = SIMILAR, together: int = TOGETHER) -> DataFrame:
    """(a, b): links that connect the contents (content, key, shingles; repeated rows do no harm) which share a key and have a Jaccard similarity of `least` or more.

    shingles: 5 bytes each, in order. Where more than `together` contents share a key, each is dealt to all pairs of blocks that its block is in.
    """

    def compare(t: pa.Table) -> pa.Table:
        key, content, block = (t.column(c).to_numpy() for c in ("key", "content", "block"))
        sets = _shingles(t.column("shingles").to_pylist())
        order = np.lexsort((content, key))
        first, _ = _groups(order, key, content)
        order = order[first]
        new, _ = _groups(order, key)
        start = np.flatnonzero(new)
        left, right, held = [], [], 0
        for s, e in zip(start, np.append(start[1:], len(order)), strict=True):
            if e - s < 2:
                continue
            mine = order[s:e]
            # shingle x paragraph, as positions: whoever shares shingles is counted, nobody else is met
            size = np.array([len(sets[k]) for k in mine])
            sh, of = np.concatenate([sets[k] for k in mine]), np.repeat(np.arange(len(mine)), size)
            by = np.argsort(sh, kind="stable")
            sh, of = sh[by], of[by]
            for k in range(len(mine)):  # one row of counts at a time
                lo, hi = np.searchsorted(sh, sets[mine[k]], "left"), np.searchsorted(sh, sets[mine[k]], "right")
                both = np.bincount(of[spread(lo, hi - lo)], minlength=len(mine))
                near = np.flatnonzero(both >= least * (size + size[k] - both) - 1e-9)
                near = near[(near > k) & ((block[mine[near]] != block[mine[k]]) | (block[mine[k]] < 0))]
                left.append(np.full(len(near), content[mine[k]]))
                right.append(content[mine[near]])
                held += len(near)
                if held > 1 << 18:
                    a, b = forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [a], [b], len(a)
        a, b = forest(np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)]))
        return pa.table({"a": a, "b": b})

    hot = contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together)
    hot = cut(hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") / together).alias("blocks")))
    each = contents.withColumn("block", F.lit(-1).cast("long"))
    if not hot.isEmpty():
        met = contents.join(hot.hint("merge"), F.col("key") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64("content"), F.col("blocks"))
        dealt = met.where("hot is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        # within its own block everything counts, and only pairs across do between two
        dealt = dealt.select("content", pair.alias("key"), "shingles", F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own")).alias("block"))
        each = met.where("hot is null").select("content", "key", "shingles", F.lit(-1).cast("long").alias("block")).unionByName(dealt)
    return each.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(compare, "a bigint, b bigint")


#: Bits of the filter that keeps documents without suspects out of a join: 8 MB, whatever the corpus. In a corpus so large that it fills up, it keeps out fewer.
FILTER_BITS = 1 << 26


def _maybe(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without most of those whose id is not in found."""
    bit = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = found.select(bit().alias("b")).select(F.bitmap_bucket_number("b").alias("bucket"), F.bitmap_bit_position("b").alias("at"))
    bits = F.broadcast(bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))  # FILTER_BITS / 32,768 rows of 4 KB at most
    d = docs.withColumn("_b", bit()).withColumn("bucket", F.bitmap_bucket_number("_b")).withColumn("_at", F.bitmap_bit_position("_b").cast("int"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return d.join(bits, "bucket").where(F.call_function("getbit", byte.cast("long"), F.col("_at") % 8) == 1).select("doc_id", "text")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, shards: int | None = None) -> DataFrame:
    """One row for each paragraph that has a similar one elsewhere: doc_id, first_word, n_words, cluster_doc, cluster_word, cluster_size, kept, line.

    Words are counted from 0 between ASCII white space. (cluster_doc, cluster_word) names the cluster by its first
    occurrence, which is the one that is kept. Pieces in runs of fewer than least_words words are not returned, and neither are those that lie
    in a repeated line, and whose first occurrence lies in the line's first one: the lines' rows say the same.
    Null and empty texts, and those of fewer than five words, have no paragraphs. Ids are integers, other kinds are an error; rows without one are not compared.
    A row that repeats another's id and text counts as an occurrence, but the two are returned as one; of one id with two texts both are returned.
    """
    return _named(docs, least_words, shards).drop("same")


def _named(docs: DataFrame, least_words: int, shards: int | None = None) -> DataFrame:
    """repeated_passages() with `same`: whether the content is that of the cluster's first occurrence, and not one similar to it."""
    spark = docs.sparkSession
    small_batches(spark)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or max(64, 4 * d.rdd.getNumPartitions())
    found = cut(suspects(d, shards).groupBy("doc_id").agg(F.collect_list("code").alias("codes")))
    mine = _maybe(d, found).join(found, "doc_id").select("doc_id", "text", "codes")

    def again(batches):
        told: set[tuple[int, int]] = set()  # contents and keys that this task has sent, up to a number; sending some twice does no harm
        for b in batches:
            ids = b.column(0).to_pylist()
            wanted: dict[int, dict[int, int]] = {}
            for i, codes in zip(ids, b.column(2).to_pylist(), strict=True):
                mine = wanted.setdefault(i, {})
                for c in codes:
                    mine[c >> 3] = mine.get(c >> 3, 0) | c & 7
            for row, skip, texts, parts in blocks(ids, b.column(1).to_pylist()):
                p = Paragraphs(texts, parts)
                doc = row[p.text]
                doubt = np.array([wanted[x].get(c, -1) for x, c in zip(doc.tolist(), p.code(skip).tolist(), strict=True)], np.int64)
                keep = np.flatnonzero(doubt >= 0)
                first, content = p.first + skip[p.text], p.content.view(np.int64)
                none = pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(first[keep]), pa.array(p.words[keep]), pa.array(p.line[keep]), pa.array(content[keep]), none, pa.nulls(len(keep), pa.binary())], names)
                ends, keys = np.append(p.at[1:], len(p.shingles)), p.bands().view(np.int64)
                out = []
                for k in np.flatnonzero(doubt > 0).tolist():
                    sets = None
                    for band in range(BANDS):
                        pair = int(content[k]), int(keys[band, k])
                        if doubt[k] >> band & 1 and pair not in told:
                            told.add(pair)
                            if sets is None:
                                sets = np.unique(p.shingles[p.at[k] : ends[k]] & U((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                            out.append((*pair, sets))
                if len(told) > 1 << 18:
                    told.clear()
                if out:
                    c, key, sets = zip(*out, strict=True)
                    none = pa.nulls(len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(out), pa.bool_()), pa.array(c, pa.int64()), pa.array(key, pa.int64()), pa.array(sets, pa.binary())], names)

    names = ["doc_id", "first_word", "n_words", "line", "content", "key", "shingles"]
    both = cut(mine.mapInArrow(again, "doc_id bigint, first_word bigint, n_words bigint, line boolean, content bigint, key bigint, shingles binary"))
    parts = both.where("key is null").drop("key", "shingles")
    roots = components(similar(both.where("key is not null").select("content", "key", "shingles"), shards))
    contents = parts.groupBy("content").agg(F.min(F.struct("doc_id", "first_word", "n_words")).alias("lead"), F.count(F.lit(1)).alias("n"))
    named = cut(contents.join(roots, F.col("content") == F.col("node"), "left").select("content", "lead", "n", F.coalesce("root", "content").alias("root")))
    clusters = named.groupBy("root").agg(F.min(F.struct("lead", "content")).alias("first"), F.sum("n").alias("cluster_size")).where("cluster_size > 1")
    # dealt anew, so that both sides of the join are shuffled and a cluster of very many contents can be split at run time
    clusters = clusters.select("root", F.col("first")["lead"].alias("lead"), F.col("first")["content"].alias("first"), "cluster_size").repartition("first")
    info = named.select("content", "root").join(clusters, "root").select("content", "lead", (F.col("content") == F.col("first")).alias("same"), "cluster_size")
    out = parts.join(info, "content").repartition("doc_id").dropDuplicates(["doc_id", "first_word", "n_words", "line", "content"])
    by_doc = W.partitionBy("doc_id", "line").orderBy("first_word")
    out = out.withColumn("run", F.sum(F.when(F.col("first_word") == F.lag(F.col("first_word") + F.col("n_words")).over(by_doc), 0).otherwise(1)).over(by_doc))
    out = out.withColumn("words", F.sum("n_words").over(W.partitionBy("doc_id", "line", "run"))).where(F.col("line") | (F.col("words") >= least_words))
    lead = F.col("lead")
    out = out.withColumn("kept", (lead["doc_id"] == F.col("doc_id")) & (lead["first_word"] == F.col("first_word")))
    # lines do not overlap, so the last one that begins before a piece ends is the only one it can lie in
    around = F.last(F.when(F.col("line"), F.struct("first_word", "n_words", "lead", "kept")), True).over(W.partitionBy("doc_id").orderBy("first_word", F.col("line").desc()))
    within = lambda at, n, first, words: (at >= first) & (at + n <= first + words)
    told = within(F.col("first_word"), F.col("n_words"), around["first_word"], around["n_words"]) & (around["kept"] == F.col("kept")) & (around["lead"]["doc_id"] == lead["doc_id"])
    told = told & within(lead["first_word"], lead["n_words"], around["lead"]["first_word"], around["lead"]["n_words"])
    out = out.withColumn("told", ~F.col("line") & F.coalesce(told, F.lit(False))).where("not told")
    return out.select("doc_id", "first_word", "n_words", lead["doc_id"].alias("cluster_doc"), lead["first_word"].alias("cluster_word"), "cluster_size", "kept", "line", "same")


def remove(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, with all their columns, without the words of repeated paragraphs that are not kept. White space around these goes too.

    A piece that is kept stays in a line that is not, if that is only similar to the line's first occurrence: what this lacks may have no other copy left.
    """
    import re

    space = re.compile("[\x20\t-\r]+")
    # similar lines first, then pieces, then equal lines: the last has its say
    rank = F.when(~F.col("line"), 1).when(F.col("same"), 2).otherwise(0)
    named = _named(docs, least_words).where("not kept or not line").groupBy(F.col("doc_id").alias("_gone"))
    spans = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "first_word", "n_words", F.col("kept").cast("long").alias("kept"))))
    flat = F.flatten(F.transform(spans, lambda x: F.array(x["first_word"], x["n_words"], x["kept"])))
    gone = named.agg(flat.alias("_spans"), F.bool_and("kept").alias("_stays")).where("not _stays")

    def shorter(text, spans):
        if text is None or spans is None:
            return text
        at = [m.end() for m in space.finditer(text)]
        starts = [0, *at] if not space.match(text) else at
        gone = np.zeros(len(starts) + 2, bool)
        for first, n, kept in np.asarray(spans).reshape(-1, 3).tolist():
            gone[first + 1 : first + n + 1] = not kept
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out, last = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out.append(text[last : starts[a]])
            last = starts[b] if b < len(starts) else len(text)
        return "".join([*out, text[last:]])

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([shorter(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    both = docs.join(gone, docs["doc_id"] == gone["_gone"], "left")
    return both.withColumn("text", without("text", "_spans")).select(*docs.columns)

"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge can be prevented only from the right, by a merge of lower rank of its right token,
which a merge of lower rank still can prevent in turn, and so on. Ranks fall along
such a chain, so how far it reaches follows from the merge list alone: lookahead()
computes it in one pass. A token that ends that far before the end of what was read
cannot change any more and is emitted; reading goes on behind it. Texts are read
in parts, words longer than a window in windows, and the tokens leave as
text and as running hashes, so memory does not grow with a text.

The first windows of many words are merged at once: each step merges one pair in every word. Short stretches between white space that occur
often are kept encoded, in a table of bounded size. A stretch without any white space is normalised, split and encoded a part at a time.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .common import small_batches

#: The code points that Unicode calls white space.
SPACE = "\t-\r \x85\xa0  -     　"
PART = 1 << 20
#: Chunks that are kept encoded, and the characters of the longest one that is.
KEPT, SHORT = 300_000, 64
#: Characters of a chunk that are worked on at once.
LONG = 1 << 13
#: Characters that a special token, or what composes with what stands before it, may need behind a cut.
HELD = 32
#: Bytes of a word that are encoded in one go; longer words go through windows.
WINDOW = 256
NO_RANK = np.int32(2**31 - 1)


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the tokenizers library: BPE over bytes with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE tokenizer")
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = merges
        size = max(*self.ids.values(), *self.special.values()) + 1
        names = [""] * size
        for name, k in [*self.ids.items(), *self.special.items()]:
            names[k] = name
        self.names, self.numbers = names, [str(k) for k in range(size)]
        self.size = size
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int32)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int32)
        a, b = (np.array([self.ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([self.ids[x + y] for x, y in merges], np.int32)
        key = a * size + b
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = made
        self.pairs = dict(zip(key.tolist(), range(len(merges)), strict=True))
        self.length = np.array([len(n.removesuffix(self.end)) if self.end else len(n) for n in names], np.int64)
        self.lookahead = lookahead([(int(x), int(y), int(z)) for x, y, z in zip(a, b, made, strict=True)], self.length)
        # what stands before the merges in the file: fixed steps, checked here so that another file is not read wrongly
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        if steps != ["NFC", "Replace", "Lowercase"] or not split or spec["decoder"] or spec["post_processor"]:
            raise ValueError("these normalizers, splits or decoders are not known")
        self.split = regex.compile(split.replace(r"^\s", f"^{SPACE}"))
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


def lookahead(merges: list[tuple[int, int, int]], length: np.ndarray) -> int:
    """How many bytes behind a token's end can decide on the token, for (left, right, made) in order of rank.

    reach[t]: bytes behind t that can decide whether t forms, or is merged away to the right, by merges so far. A
    merge (a, b) waits on reach[b]; so whoever needs a at a higher rank waits on b and that.
    """
    reach: dict[int, int] = {}
    for a, b, made in merges:
        r = reach.get(b, 0)
        reach[made] = max(reach.get(made, 0), r)
        reach[a] = max(reach.get(a, 0), int(length[b]) + r)
    return max(reach.values(), default=0)


# ---------------------------------------------------------------- encoding


def encode_words(v: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """The tokens of whole, non-empty words: in each step the pair of lowest rank, leftmost, is merged in every word."""
    if not words:
        return []
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = v.inner[flat]
    ends = np.cumsum(n) - 1
    sym[ends] = v.last[flat[ends]]
    word = np.repeat(np.arange(len(words)), n)
    rank = np.full(len(sym), NO_RANK)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = v.rank(sym[inside], sym[inside + 1])
    done_word, done_sym = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        going = np.repeat(least != NO_RANK, sizes)
        if not going.all():
            done_word.append(word[~going])
            done_sym.append(sym[~going])
            sym, word, rank = sym[going], word[going], rank[going]
            least, sizes = least[least != NO_RANK], sizes[least != NO_RANK]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
        sym[hit] = v.made[rank[hit]]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        sym, word, rank = sym[stay], word[stay], rank[stay]
        hit = hit - np.arange(len(hit))
        for at in (hit, hit[hit > 0] - 1):
            at = at[at + 1 < len(sym)]
            same = word[at] == word[at + 1]
            rank[at[~same]] = NO_RANK
            at = at[same]
            rank[at] = v.rank(sym[at], sym[at + 1])
        if len(sym):
            rank[-1] = NO_RANK
    word, sym = np.concatenate(done_word), np.concatenate(done_sym)
    order = np.argsort(word, kind="stable")
    tokens = sym[order].tolist()
    upto = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
    return [tokens[a:b] for a, b in zip([0, *upto], upto, strict=False)]


def _merge_window(v: Vocabulary, sym: list[int]) -> list[int]:
    """BPE of one list of symbols."""
    n = len(sym)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    live = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := v.pairs.get(sym[i] * v.size + sym[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if live[i] else -1
        if j < 0 or v.pairs.get(sym[i] * v.size + sym[j]) != r:
            continue
        sym[i], live[j], after[i] = int(v.made[r]), False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (x := v.pairs.get(sym[a] * v.size + sym[b])) is not None:
                heapq.heappush(heap, (x, a))
    return [s for s, k in zip(sym, live, strict=True) if k]


class Transducer:
    """The tokens of one word whose bytes come in parts, each emitted once no further byte can change it. What is held is no longer than a window, or twice the longest token and the lookahead."""

    def __init__(self, v: Vocabulary, window: int | None = None) -> None:
        self.v, self.window, self.held = v, 4 * WINDOW if window is None else window, b""
        self.reach = max(1, v.lookahead)  # whether a byte is the word's last one changes its letter

    def push(self, data: bytes, last: bool) -> list[int]:
        data, at, size, out, v = self.held + data, 0, self.window, [], self.v
        while at < len(data) and (last or len(data) - at >= size):
            end = min(len(data), at + size)
            flat = np.frombuffer(data[at:end], np.uint8)
            sym = v.inner[flat].tolist()
            whole = last and end == len(data)
            if whole:
                sym[-1] = int(v.last[flat[-1]])
            tokens = _merge_window(v, sym)
            if whole:
                self.held = b""
                return out + tokens
            began = at
            for t in tokens:
                if at + v.length[t] > end - self.reach:
                    break
                at += int(v.length[t])
                out.append(t)
            if at == began:
                size *= 2
        self.held = data[at:]
        return out


def encode_long(v: Vocabulary, word: bytes, window: int | None = None, part: int = 1 << 12) -> Iterator[int]:
    """The tokens of one word, which passes in parts."""
    t = Transducer(v, window)
    for at in range(0, len(word), part):
        yield from t.push(word[at : at + part], at + part >= len(word))


def _lower(s: str) -> str:
    """Lower-cases each character by itself, whatever stands next to it."""
    return "".join(c.lower() for c in s) if "Σ" in s else s.lower()


_LETTERS, _OTHERS = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")


class Encoder:
    """Encodes texts; keeps the tokens of at most KEPT chunks between white space, of SHORT characters at most."""

    def __init__(self, v: Vocabulary, kept: int = KEPT) -> None:
        self.v, self.kept = v, kept
        self.known: dict[str, tuple[str, list[int]]] = {}

    def _words(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk as UTF-8, and the ids of special tokens in it."""
        if self.v.specials and "<" in chunk and (m := self.v.specials.search(chunk)):
            return [*self._words(chunk[: m.start()]), self.v.special[m[0]], *self._words(chunk[m.end() :])]
        s = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        s = _lower(s)
        if s.isalpha():
            return [s.encode("utf-8", "replace")]
        return [w.encode("utf-8", "replace") for w in self.v.split.findall(s)]

    def encode(self, chunks: list[str]) -> list[tuple[str, list[int]]]:
        """(ids in decimal with a space between, ids) of each chunk; those that are not known are encoded all at once."""
        out = [self.known.get(c) for c in chunks]
        new = [k for k, x in enumerate(out) if x is None]
        parts = [self._words(chunks[k]) for k in new]
        short = list({w for p in parts for w in p if isinstance(w, bytes) and len(w) <= WINDOW})
        found: dict[bytes | int, list[int]] = dict(zip(short, encode_words(self.v, short), strict=True))
        numbers = self.v.numbers
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
        for k, p in zip(new, parts, strict=True):
            t = [x for w in p for x in ([w] if isinstance(w, int) else found[w] if w in found else encode_long(self.v, w))]
            out[k] = " ".join([numbers[x] for x in t]), t
            if len(chunks[k]) <= SHORT and len(self.known) < self.kept:
                self.known[chunks[k]] = out[k]
        return out

    def _cut(self, raw: str) -> int:
        """Where raw may be cut: no special token and nothing that composes stands across."""
        for k in range(len(raw) - HELD, 0, -1):
            before, c = raw[max(0, k - HELD) : k], raw[k]
            if c.isascii() or (not unicodedata.combining(c) and unicodedata.normalize("NFC", before + c) == unicodedata.normalize("NFC", before) + unicodedata.normalize("NFC", c)):
                return k
        return 0

    def _split(self, s: str, run: regex.Pattern | None, word: Transducer, closed: bool, out: list[int]) -> tuple[str, regex.Pattern | None]:
        """Encodes what is sure of s, of which more comes unless closed: (the rest, what a word goes on with that has no end yet)."""
        at = 0
        if run is not None:
            at = run.match(s).end()
            if at == len(s) and not closed:
                out += word.push(s.encode("utf-8", "replace"), False)
                return "", run
            out += word.push(s[:at].encode("utf-8", "replace"), True)
        for m in self.v.split.finditer(s, at):
            if closed or m.end() < len(s) - 3:  # three characters tell whether a contraction begins
                out += word.push(m[0].encode("utf-8", "replace"), True)
            elif m.end() == len(s) and len(m[0]) > HELD:
                out += word.push(m[0].encode("utf-8", "replace"), False)
                return "", _LETTERS if _LETTERS.match(m[0]).end() else _OTHERS
            else:
                return s[m.start() :], None
        return "", None

    def _long(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """The ids of text[at:end], which has no white space, a part at a time."""
        raw, s, run, word = "", "", None, Transducer(self.v)
        while at < end or raw:
            if len(raw) < LONG:
                raw, at = raw + text[at : min(end, at + LONG)], min(end, at + LONG)
            m = self.v.specials.search(raw) if self.v.specials and "<" in raw else None
            cut = m.start() if m else len(raw) if at == end else self._cut(raw)
            out: list[int] = []
            s, run = self._split(s + _lower(unicodedata.normalize("NFC", raw[:cut])), run, word, bool(m) or cut == len(raw) and at == end, out)
            if m:
                out.append(self.v.special[m[0]])
            raw = raw[m.end() if m else cut :]
            yield out

    def stream(self, text: str) -> Iterator[tuple[str, list[int]]]:
        """The ids of a text, as by encode(), a part at a time."""
        at = 0
        while at < len(text):
            end = min(len(text), at + PART)
            if end < len(text):  # back to white space, or on to it if there is none
                gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                m = _SPACE.search(text, at if gap <= at else gap)
                end = m.start() if m and m.start() <= end else end if gap > at else m.start() if m else len(text)
            if end - at > PART:
                for ids in self._long(text, at, end):
                    yield " ".join([self.v.numbers[x] for x in ids]), ids
            else:
                held: list[str] = []
                for c in split(text[at:end]):
                    if len(c) <= LONG:
                        held.append(c)
                        continue
                    yield from self.encode(held)
                    held = []
                    for ids in self._long(c, 0, len(c)):
                        yield " ".join([self.v.numbers[x] for x in ids]), ids
                yield from self.encode(held)
            at = end
            m = _SPACE.match(text, at)
            at = m.end() if m else at

    def ids(self, text: str | None) -> list[int]:
        return [x for _, part in self.stream(text or "") for x in part]


def split(text: str) -> list[str]:
    """The chunks between white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
        return [c for c in _SPACE.split(text) if c]
    return text.split()


_SPACE = re.compile(f"[{SPACE}]+")


@contextmanager
def uncollected() -> Iterator[None]:
    """Holds off the search for cycles, of which tokens and chunks make none but which goes over all that are kept time and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Vocabulary(path))


class Decoder:
    """Tokens to text, some at a time.

    With byte letters the state is the bytes of a character that is not whole yet; bytes that are no UTF-8 become U+FFFD. Without (the
    file names no decoder) token names are put out with a space between them, and the state is whether one came before.
    """

    def __init__(self, names: list[str], byte_level: bool) -> None:
        self.names, self.byte_level, self.some = names, byte_level, False
        self.of = {c: b for b, c in enumerate(byte_letters())} if byte_level else {}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        """What can be told of the text after these tokens, and not before."""
        names = self.names
        if not self.byte_level:
            text = " ".join([names[t] for t in tokens])
            lead, self.some = " " if self.some and text else "", self.some or bool(text)
            return lead + text
        out = []
        for name in map(names.__getitem__, tokens):
            if all(c in self.of for c in name):
                out.append(self.state.decode(bytes(self.of[c] for c in name)))
            else:
                out += [self.state.decode(b"", True), name]
        return "".join(out)

    def close(self) -> str:
        self.some = False
        return self.state.decode(b"", True)


def decode(names: list[str], ids: Iterable[int], byte_level: bool = False) -> str:
    d = Decoder(names, byte_level)
    return d.feed(ids) + d.close()


# ---------------------------------------------------------------- DataFrames


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text, as an array. Null text: an empty array."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.ids(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of arrays of token ids; null: null."""
    d = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        names = encoder(path).v.names
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(names, x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null, empty and white texts have no tokens and the hash of nothing. Repeated rows are
    returned as often as they occur. The tokens pass through running hashes and are not held.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def told(stream: Iterable[tuple[str, list[int]]], names: list[str]) -> tuple[int, str, str]:
        n, h, g, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(names, False)
        stream = iter(stream)
        while part := [x for x in islice(stream, 4096) if x[1]]:
            ids = [t for _, ids in part for t in ids]
            h.update(((" " if n else "") + " ".join([x for x, _ in part])).encode())
            g.update(back.feed(ids).encode())
            n += len(ids)
        g.update(back.close().encode())
        return n, h.hexdigest(), g.hexdigest()

    def run(batches):
        e = encoder(path)
        for t in blocks(batches, 1):
            yield block(e, t)

    def block(e: Encoder, t: pa.Table) -> pa.RecordBatch:
        with uncollected():
            texts = t.column(1).to_pylist()
            # the different chunks of the block are encoded once; a long text, or one with a long chunk, passes by itself
            parts = [split(x or "") if len(x or "") <= PART else None for x in texts]
            parts = [None if p and max(map(len, p)) > LONG else p for p in parts]
            some = pa.array([c for p in parts if p for c in p], pa.string()).dictionary_encode()
            known = e.encode(some.dictionary.to_pylist())
            at, chunk, out = 0, some.indices.to_pylist(), []
            for x, p in zip(texts, parts, strict=True):
                if p is None:
                    out.append(told(e.stream(x), e.v.names))
                else:
                    out.append(told(map(known.__getitem__, chunk[at : at + len(p)]), e.v.names))
                    at += len(p)
            n, ids, back = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

import hashlib
import math
import random
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from panewright.llm import blocks, bpe, language_id, lm_scoring, mixing, quality, token_counts

DOCS = "doc_id long, text string"
public = pytest.importorskip("public_tokenizers")


# ---------------------------------------------------------------- mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares again what is above a limit until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    open_, target, left = set(order), dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 100_000]) for s in [None, "", "a", "b", "É", "zz", "😀", "￿"]}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(5000, None, "a"), (None, "x y", "b"), (1, "dup dup", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("copies", F.lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
    assert len(by) == 4
    for (size, target), rows in by.items():
        assert sum(r["size"] for r in rows) == size and sum(r.taken for r in rows) == pytest.approx(target, rel=0.03)
        each = target / size
        assert {r.copies for r in rows} <= {math.floor(each), math.ceil(each)}
    rows = mixing.repeat(df)
    assert rows.columns == df.columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_word_rule(spark):
    texts = ["a b", " a\x0b\x0c\tb\r\n", "a b", "", None, "\x1ca"]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOCS).orderBy("doc_id").select(mixing.words(F.col("text")).alias("n")).collect()]
    assert got == [2, 2, 1, 0, 0, 1]


# ---------------------------------------------------------------- language ID


def test_vectors_bind_and_bundle():
    v = language_id._vectors()
    a, b, c = 3, 5, 7
    gram = np.array([a * 128**2 + b * 128 + c])
    assert (language_id.bind(gram)[0] == np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]).all()
    text = "Ab, àb"
    row, got = next(language_id._bundles([text]))
    x = language_id._letters()[[ord(ch) for ch in " ab àb "]].astype(int)
    want = sum(np.roll(v[x[k]], 2) * np.roll(v[x[k + 1]], 1) * v[x[k + 2]] for k in range(len(x) - 2))
    assert row == 0 and (got == want).all()


def test_language_accuracy(spark, sf_dir):
    df = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    data = [(1, "hello there", "en"), (3, "buenos días", "es"), (4, "hello again there", None), (5, None, "en"), (6, "12 !", "en"), (7, "", "en"), (None, "hello", "en"), (8, "x" * 3_000_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("held_out", F.lit(1)).withColumn("score", F.lit(2))
    got = {r.doc_id: r for r in language_id.identify(df, split=lambda c: F.lit(False)).collect()}
    assert [got[k].lang_pred for k in (1, 3, 4)] == ["en", "es", "en"] and [(got[k].lang_pred, got[k].score) for k in (5, 6, 7)] == [("und", 0.0)] * 3
    nobody = language_id.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in nobody} == {"und"}
    assert language_id.identify(df.where("false")).count() == 0


# ---------------------------------------------------------------- BPE

PATH = public.path("word_bpe_49k.json")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" * 2 + "éèçñßΣσİäöü0123456789!?.,'|-—中文字\x1c\x85\xa0  \t\n ABCDEFG🙂́‍"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return [*made, "it's we'll I'D <|startoftext|>abc<|endoftext|>x <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ΑΣ", "", " \n", "th" * 600, "ab" * 5000]


def test_bpe_equals_the_library(library):
    e = bpe.Encoder(bpe.Vocabulary(PATH), kept=500)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert e.ids(t) == want, t
        assert bpe.decode(e.v.names, want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("window", [150, 200, 400])
def test_windows_with_enough_lookahead(library, window):
    v = bpe.Vocabulary(PATH)
    assert 0 < v.lookahead < 400
    rng = random.Random(window)
    for k in range(60):
        w = "".join(rng.choice(["th", "in", "e", "aa", "ing", "tion", "x"] if k % 2 else "ab") for _ in range(500))
        assert list(bpe.encode_long(v, w.encode(), window)) == library.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize(("long", "part"), [(40, 90), (100, 10_000), (8192, 1 << 20)])
def test_texts_without_white_space_are_streamed(library, monkeypatch, long, part):
    monkeypatch.setattr(bpe, "LONG", long)
    monkeypatch.setattr(bpe, "PART", part)
    e = bpe.Encoder(bpe.Vocabulary(PATH), kept=50)
    rng = random.Random(long)
    bits = ["it's", "we'll", "'", "''", "!!!", "'re", "th", "Ing", "é", "e\u0301", "\u1100\u1161\u11a8", "İ", "ΑΣ", "12", "中文", "<|endoftext|>", "<|endof", "a" * 90, "-" * 90, "🙂", "\u0327\u0301", " ", "\n\n", "\x1c"]
    for k in range(150):
        t = "".join(rng.choice(bits[: len(bits) - 3 * (k % 2)]) for _ in range(60))
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids, t
    t = "".join(rng.choice("etaoin") for _ in range(60_000))
    got = list(e.stream(t))
    assert [x for _, p in got for x in p] == library.encode(t, add_special_tokens=False).ids and max(len(p) for _, p in got) < max(2 * long, 2000)
    assert len(e.known) <= 50 and all(len(c) <= bpe.SHORT for c in e.known)


def test_what_a_transducer_holds_does_not_grow():
    v = bpe.Vocabulary(PATH)
    t, out = bpe.Transducer(v), []
    for _ in range(300):
        out += t.push(b"onthing" * 100, False)
        assert len(t.held) < 2048
    out += t.push(b"", True)
    assert t.held == b"" and out == list(bpe.encode_long(v, b"onthing" * 30_000))


def test_lookahead_of_a_small_list():
    # 0 a, 1 b, 2 c: (b, c) goes before (a, b), so whether ab merges waits for one more byte
    length = np.array([1, 1, 1, 2, 2])
    assert bpe.lookahead([(1, 2, 3), (0, 1, 4)], length) == 2
    assert bpe.lookahead([], length) == 0


def test_incremental_decoding():
    letters = bpe.byte_letters()
    whole = "né 中🙂"
    names = [letters[b] for b in whole.encode()] + [letters[0xFF], "<|end|> é"]
    d = bpe.Decoder(names, True)
    steps = [d.feed([k]) for k in range(len(whole.encode()))]
    assert "".join(steps) == whole and "" in steps
    assert bpe.decode(names, [len(names) - 2], True) == "�"
    assert d.feed([len(names) - 1]) == "<|end|> é"
    d = bpe.Decoder(["a</w>", "b"], False)
    assert [d.feed([0, 1]), d.feed([]), d.feed([1])] == ["a</w> b", "", " b"]


def test_bpe_digests(spark, library):
    docs = [(k, t) for k, t in enumerate(texts()[-40:])] + [(100, None), (100, None), (None, "x"), (101, "word " * 300_000)]
    got = sorted(map(tuple, bpe.digests(spark.createDataFrame(docs, DOCS).withColumn("id", F.lit(1)), PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digests(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_bpe_arrays(spark, library):
    ids = bpe.encode(spark.createDataFrame([(1, "Hello there"), (2, None)], DOCS), PATH)
    assert {r.id: r.ids for r in ids.collect()} == {1: library.encode("Hello there", add_special_tokens=False).ids, 2: []}
    assert {r.id: r.text for r in bpe.decoded(ids, PATH).collect()} == {1: "hello</w> there</w>", 2: ""}


# ---------------------------------------------------------------- token counts

PIECES = public.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    from tokenizers.models import Unigram

    pieces = token_counts.vocabulary(PIECES)
    mine, library_ = token_counts.Counter(pieces, kept=300), Unigram(pieces, unk_id=0, byte_fallback=True)
    for t in texts()[:800]:
        assert mine.count(t) == (len(library_.tokenize("▁" + t.replace(" ", "▁"))) if t else 0), t
    rng = random.Random(3)
    small = [("<unk>", 0.0), ("a", -1.5), ("b", -1.7), ("ab", -3.2), ("ba", -3.1), ("aba", -4.7), ("bb", -3.4)]
    mine, library_ = token_counts.Counter(small), Unigram(small, unk_id=0)
    for _ in range(1500):
        t = "".join(rng.choice("abz") for _ in range(rng.randint(1, 14)))
        assert mine.viterbi(t) == len(library_.tokenize(t)), t


def test_best_score_against_all_splits():
    pieces = [("a", -2.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("aab", -5.0)]
    c = token_counts.Counter(pieces)
    scores = dict(pieces)

    def splits(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) if s[:k] in scores for r in splits(s[k:])]

    for k in range(1, 200):
        s = bin(k)[2:].replace("0", "a").replace("1", "b")
        best = max(sum(scores[p] for p in x) for x in splits(s))
        assert c.viterbi(s) in {len(x) for x in splits(s) if sum(scores[p] for p in x) == best}


def test_counts_frame(spark):
    docs = [(1, "hello there"), (1, "hello there"), (2, None), (3, ""), (None, "x"), (4, "y" * 100_000)]
    got = Counter((r.doc_id, r.n_chars) for r in token_counts.token_counts(spark.createDataFrame(docs, DOCS).withColumn("n_tokens", F.lit(1)), PIECES).collect())
    assert got == Counter({(1, 11): 2, (2, 0): 1, (3, 0): 1, (None, 1): 1, (4, 100_000): 1})


# ---------------------------------------------------------------- language models


def kneser_ney(levels):
    """levels[k]: how often each gram of order k counts. The discounts, and by history the total and how many grams have each discount."""
    stats = {}
    for k, c in levels.items():
        n = Counter(min(v, 5) for v in c.values())
        d = lm_scoring.discounts([n[1], n[2], n[3], n[4]])
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append((v, d[min(v, 3) - 1]))
        stats[k] = (d, {h: (sum(v for v, _ in x), sum(o for _, o in x)) for h, x in by.items()})
    return stats


def slow_entries(text):
    """Grams of order 5 of a text: chunks after four starts, with an end; a repeated chunk is one symbol."""
    out, last = [], None
    for c in (text or "").split():
        x = "\0" * 4 + ("\2" if c == last else c) + " "
        out += [tuple(x[k - 4 : k + 1]) for k in range(4, len(x))]
        last = c
    return out


def slow_model(texts_):
    """Interpolated modified Kneser-Ney by dictionaries: the probability of a gram's last symbol after the others."""
    levels = {5: Counter(g for t in texts_ for g in slow_entries(t))}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = kneser_ney(levels)

    def p(g, k=5):
        if k == 0:
            return 1 / (1 + len(levels[1]))
        g = g[-k:]
        d, by = stats[k]
        lower = p(g, k - 1)
        if g[:-1] not in by:
            return lower
        total, given = by[g[:-1]]
        v = levels[k][g]
        return (v - d[min(v, 3) - 1] if v else 0) / total + given / total * lower

    return p


ODD = ["zzz ÄÖ 12", "abcd abcd abcd", "кот и дом", "猫犬 7", "x" * 10_000, None, "", " \n", "a\0b \x02 \x02"]


def test_character_model_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(quality, "LONG", 50)
    monkeypatch.setattr(quality, "STEP", 500)
    monkeypatch.setattr(quality, "MET", 1)
    rng = random.Random(2)
    corpus = ["".join(rng.choice("aab bcd.\n") for _ in range(400)) for _ in range(5)] + ["дом дом кот", None, "", "y" * 333]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*corpus, *ODD])], "id long, text string, lang string").repartition(3)
    table, unseen = quality.fit(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(2))
    p = slow_model([t for t in corpus if t])
    got = {r.id: r for r in quality.score(docs, table, unseen).collect()}
    assert len(got) == len(corpus) + len(ODD)
    for k, t in enumerate([*corpus, *ODD]):
        g = slow_entries((t or "").replace("\0", "\1").replace("\2", "\1"))
        assert got[k].n_symbols == len(g), t
        assert got[k].bits == pytest.approx(-sum(math.log2(p(x)) for x in g), rel=1e-4), t
    alphabet = {x for t in corpus for g in slow_entries(t) for x in g[-1:]}
    assert sum(p((*"\0\0ab", x)) for x in alphabet) == pytest.approx(1 - p((*"\0\0ab", "?")), rel=1e-6)
    nothing, one = quality.fit(docs.where("id < 0").select("text"))
    assert nothing.count() == 0 and {r.bits for r in quality.score(docs, nothing, one).collect()} == {0.0}


def test_blocks_and_packing():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(5, dtype=np.uint64)):
        assert (blocks.unpack(blocks.pack(a), np.uint64) == a).all() and (blocks.unpack_sorted(blocks.pack_sorted(np.sort(a))) == np.sort(a)).all()
    import pyarrow as pa

    texts = ["a b  a", None, "", "\n c\u3000a", "x" * 50, "b"]
    batch = pa.record_batch([pa.array(texts, pa.string()), pa.array(range(6))], ["t", "k"])
    tables = list(blocks.blocks(iter([batch, batch]), 0, most=40 + 2 * blocks.ROW))
    assert [k for t in tables for k in t.column(1).to_pylist()] == [*range(6)] * 2 and len(tables) > 2
    at, sizes, different = blocks.chunks(tables[0].column(0))
    assert [different[k] for k in at] == [w for t in tables[0].column(0).to_pylist() for w in (t or "").split()]
    assert sizes.tolist() == [len((t or "").split()) for t in tables[0].column(0).to_pylist()]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_quality(scored):
    docs, labels, known = scored
    got = quality.classify(docs.withColumn("kept", F.lit(1)), labels.withColumn("lang", F.lit("x"))).collect()
    assert len(got) == docs.count()
    kept = lambda q: np.mean([r.kept for r in got if r.doc_id in known and known[r.doc_id].quality == q])
    assert kept(1) >= 0.99 and kept(0) < 0.1, (kept(1), kept(0))


def test_quality_edges(spark, scored):
    docs, labels, _ = scored
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "Hello of the and.", None), (-4, "Hello of the and.", None), (-4, "Hello of the and.", None), (None, "x", "zz")], "doc_id long, text string, lang string")
    got = [r for r in quality.classify(docs.select("doc_id", "text", "lang").unionByName(odd), labels).collect() if r.doc_id is None or r.doc_id < 0]
    assert Counter(r.doc_id for r in got) == Counter([-1, -2, -3, -4, -4, None])
    by = {r.doc_id: r for r in got}
    assert not by[-1].kept and not by[-2].kept and by[-1].perplexity is None and by[-3].threshold > 0 and by[None].threshold > 0
    assert by[-3].perplexity == pytest.approx(by[-4].perplexity)
    none = quality.classify(odd, labels.where("false")).collect()
    assert {r.doc_id: r.kept for r in none} == {-1: False, -2: False, -3: True, -4: True, None: True}
    assert quality.classify(odd.where("false"), labels).count() == 0


def test_quality_limits_cover_all_trusted_documents(spark):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice("abcdefgh " if k % 3 else "nopq rst") for _ in range(20 + 7 * k)), "xyz"[k % 3]) for k in range(40)]
    df = spark.createDataFrame([*docs, docs[7]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(40)], "doc_id long, quality int")
    fitted = {r.trusted_id for r in quality.sample(quality.trusted(labels), 2).collect()}
    assert len(fitted) == 2
    plain, got = (quality.classify(df, labels, most=2, prior=p).collect() for p in (0, 100))
    bits = {r.doc_id: r.n_symbols * math.log2(r.perplexity) for r in plain}
    size = {r.doc_id: r.n_symbols for r in plain}
    good = [k for k, _, _ in [*docs, docs[7]] if k % 5 and k not in fitted]
    mean = {z: sum(bits[k] for k in good if k % 3 == z) / sum(size[k] for k in good if k % 3 == z) for z in range(3)}
    loss = {k: (bits[k] + 100 * mean[k % 3]) / (size[k] + 100) for k in bits}
    assert len(got) == 41
    for r in got:
        mine = [loss[x] for x in good if x % 3 == r.doc_id % 3]
        assert math.log2(r.perplexity) == pytest.approx(loss[r.doc_id])
        assert math.log2(r.threshold) == pytest.approx(max(mine) + quality.SLACK)
        assert r.kept == (loss[r.doc_id] <= max(mine) + quality.SLACK)


def test_cross_entropy_difference(spark, scored):
    docs, labels, known = scored
    got = lm_scoring.cross_entropy_difference(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == docs.count()
    ranked = sorted((r.score, known[r.doc_id].quality) for r in got if r.doc_id in known)
    good = sum(q for _, q in ranked)
    above, pairs = 0, 0
    for _, q in ranked:
        above += q
        pairs += 0 if q else above
    assert pairs / good / (len(ranked) - good) > 0.93  # how often junk scores above a good document
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "ab"), (None, "ab"), (3, " \n"), (4, "y" * 200_000), (5, "Дом " * 50_000)], DOCS).withColumn("n", F.lit(1))
    few = sorted(((r.doc_id, r.n_symbols, r.score) for r in lm_scoring.cross_entropy_difference(odd, labels.where("false")).collect()), key=str)
    assert few == sorted([(1, 0, None), (2, 0, None), (2, 2, 0.0), (None, 2, 0.0), (3, 0, None), (4, 2, 0.0), (5, 50_001, 0.0)], key=str)
    assert lm_scoring.cross_entropy_difference(odd.where("false"), labels).count() == 0


def test_symbols_are_cut_for_all_texts_at_once(monkeypatch):
    """Symbols are those of the pattern for each character's class; no call is made for each different chunk of a block."""
    cjk = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}"
    each = regex.compile(rf"[{cjk}]|[[\p{{L}}\p{{M}}]--[{cjk}]]+|\p{{N}}|[^\s\x1C-\x1F\p{{L}}\p{{M}}\p{{N}}]", regex.V1)

    def check(texts):
        seq, n, names = lm_scoring.symbols(pa.chunked_array([pa.array(texts, pa.string())]))
        want = [w and [*w, ""] for t in texts for w in [each.findall((t or "").lower())]]
        assert n.tolist() == [len(w) for w in want] and [names[k] for k in seq] == [x for w in want for x in w]
        assert len(set(names)) == len(names) and "" in names
        often = np.bincount(seq, minlength=len(names)).tolist()
        assert often == sorted(often, reverse=True)

    rng, some = random.Random(11), [*"aΣςİß7٣猫か.,_'\n\t\x1c\x85\xa0\u3000\u200b\u180e\0", "e\u0301", "क्ष", "𝒜", "😀", " ", " ", "Word", "ΟΔΟΣ"]
    for piece in (2, 3, 7, 64, 1 << 20):  # a symbol may go on in the next piece
        monkeypatch.setattr(lm_scoring, "PIECE", piece)
        check([None, "", " \n", *("".join(rng.choices(some, k=rng.choice([1, 2, 5, 40, 200]))) for _ in range(60)), "y" * 300, "y" * 128, "yÉ" * 64 + "7" + "é" * 200 + " z"])
        check([])
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(["a" + c + "b" + c + c + " Σ" + c for c in every[:: 7]])
    calls = Counter()
    texts = pa.chunked_array([pa.array([" ".join(f"w{chr(97 + k % 26)}{k}," for k in range(20_000))])])
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    lm_scoring.symbols(texts)
    sys.setprofile(None)
    assert calls.total() < 5_000, calls  # 20,000 different chunks


def test_ordered_is_a_stable_argsort():
    rng = np.random.default_rng(5)
    for bits in (1, 17, 36, 48, 60, 64):
        for n in (0, 1, 2, 3, 5000, 1 << 17):
            key = rng.integers(0, 2**bits - 1, n, np.uint64, endpoint=True)
            key[::3] = key[:1]  # repeated, and different in the last bit only
            key[1::7] = key[:1] ^ np.uint64(1)
            assert (blocks.ordered(key, bits) == np.argsort(key, kind="stable")).all()
    low = rng.integers(0, 50, 1 << 17, np.uint64)  # the bits that differ are those left out
    assert (blocks.ordered(low, 64) == np.argsort(low, kind="stable")).all()
    key = rng.integers(0, 1 << 64, 5000, np.uint64)
    for shards in (1, 12, 1 << 16, (1 << 16) + 1):
        order, bits, edges = blocks.by_shard(key, shards)
        for a, b in zip(edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0], strict=True):
            assert (np.diff(bits[a:b].astype(np.int64)) >= 0).all()
        assert sorted(order.tolist()) == list(range(5000)) and (bits == key[order] >> np.uint64(16)).all() and edges[-1] == 5000


def test_documents_are_scored_in_slices_of_a_block(monkeypatch):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 60, 4000)
    n[[0, 5, 6, 7, 3999]] = 0
    n[17] = 30_000
    seq, v = rng.zipf(1.3, n.sum()) % 5000, 5000
    row = {"n": n.tolist(), "luck": blocks.pack(rng.integers(0, 1 << 32, len(n)).astype(np.uint32)), "seq": blocks.pack(seq.astype(np.uint32)), "words": rng.integers(0, 1 << 63, v).astype(np.uint64).tobytes(), "at": list(range(0, len(n), 7))}
    b = lm_scoring.Block(row, 0.2, 12)
    pairs, words = np.stack(b.counts).astype(np.int64), rng.integers(200_001, 200_009, (15, v))
    pairs[2] += 1
    off, stats = [(0.5, 1.0, 1.5)] * 3, [[1000, 500, 200, 100, v, 10 * v]] * 3
    most = []

    def losses(symbols):
        monkeypatch.setattr(lm_scoring, "SCORED", symbols)
        tracemalloc.start()
        got = lm_scoring.losses(b, pairs, words, off, off, stats, v)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return got

    whole, parts = losses(1 << 40), losses(1 << 12)
    assert np.allclose(whole, parts, rtol=1e-12, atol=0) and (parts[:, n == 0] == 0).all() and (parts[:, n > 0] != 0).all()
    assert most[1] < most[0] / 2, most
    assert np.allclose(whole, losses(1), rtol=1e-12, atol=0)


def test_word_pairs_against_dictionaries(spark, monkeypatch):
    """Each document's losses by dictionaries from which its own counts are taken out; discounts and sums over the vocabulary stay."""
    monkeypatch.setattr(blocks, "ROW", blocks.BLOCK // 5)  # blocks of five rows
    rng = random.Random(7)
    texts_ = [" ".join(rng.choice(["tea", "milk", "Дом", "кот", "sun,", "moon", "rain"][: 3 + k % 5]) for _ in range(3 + k)) for k in range(24)]
    texts_ += [texts_[3], "слово раз", "猫犬 7", "tea " * 30]
    good = {k for k in range(len(texts_)) if k % 4 == 0}
    df = spark.createDataFrame([*enumerate(texts_), (5, texts_[5])], DOCS).repartition(2)
    rows = [(r.doc_id, r.text, r.luck) for r in df.withColumn("luck", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))).collect()]

    def pairs(t):
        w = [x for part in t.lower().split() for x in (["猫", "犬"] if part == "猫犬" else ["sun", ","] if part == "sun," else [part])]
        return list(zip(["", *w], [*w, ""], strict=True))

    vocabulary = {w for t in texts_ for _, w in pairs(t)}
    size = lambda k: sum(len(pairs(t)) for i, t, _ in rows if k(i))
    rate = size(lambda i: i in good) / size(lambda i: True)
    sets = {"target": lambda i, x: i in good, "background": lambda i, x: x < rate * 2**32, "corpus": lambda i, x: True}
    assert 0 < sum(sets["background"](i, x) for i, _, x in rows) < len(rows)

    def slow(name):
        every = Counter(p for i, t, x in rows if sets[name](i, x) for p in pairs(t))
        follow = Counter(w for _, w in every)
        offs = []
        for c in (every, follow):
            n = Counter(c.values())
            offs.append(lm_scoring.discounts([n[k] for k in (1, 2, 3, 4)]))
        off = lambda v, k: offs[k][min(v, 3) - 1] if v else 0.0
        total, spare = sum(follow.values()), sum(off(v, 1) for v in follow.values()) / len(vocabulary)

        def loss(i, t, x):
            mine = Counter(pairs(t))
            left = every - mine if sets[name](i, x) else every
            after = Counter(w for _, w in left)
            bits = 0.0
            for (h, w), n in mine.items():
                low = (after[w] - off(after[w], 1) + spare) / total if total else 1 / len(vocabulary)
                hist = [v for (a, _), v in left.items() if a == h]
                bits -= n * math.log2((left[h, w] - off(left[h, w], 0) + sum(off(v, 0) for v in hist) * low) / sum(hist) if hist else low)
            return bits / sum(mine.values())

        return loss

    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = lm_scoring.cross_entropy_difference(df, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(texts_)), 5])
    want = {m: {i: f(i, t, x) for i, t, x in rows} for m in sets for f in [slow(m)]}
    for r in got:
        assert r.n_symbols == len(pairs(texts_[r.doc_id]))
        for m in sets:
            assert r[f"{m}_loss"] == pytest.approx(want[m][r.doc_id]), m
        assert r.score == pytest.approx(r.target_loss - r.background_loss)

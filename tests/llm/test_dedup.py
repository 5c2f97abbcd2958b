import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panewright.llm import components, embedding_dedup, exact_dedup, queries, simhash, substring_dedup

DOCS = "doc_id long, text string"


def fold(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = fold(real, {x for e in real for x in e})
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values()))


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_do_not_grow_with_rounds(spark, monkeypatch):
    bits, cut = [], components.cut_unsized

    def measured(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(components, "cut_unsized", measured)
    got = components.components(spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == 20_001 and got.select("root").distinct().count() == 1
    assert len(bits) >= 3 * 5 and max(bits) <= 64, bits


def test_forest():
    a, b = components.forest(np.array([1, 2, 3, 9, 9]), np.array([2, 3, 1, 8, 9]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 2), (1, 3), (8, 9)]
    assert len(components.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


# ---------------------------------------------------------------- exact dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


EXACT = [(1, "Some Text"), (2, "some text"), (3, "some text "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "tat " * 9000), (9, "TAT " * 9000), (10, "x" * 50_000), (11, "x" * 49_999), (2, "some text"), (12, "line\nkat line " * 500), (13, "line\nkat line " * 500)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    df = spark.createDataFrame(EXACT, DOCS).withColumn("keep_id", F.lit(0)).withColumn("id", F.lit("x"))
    more = {"key": lambda c: F.pmod(F.xxhash64(c), F.lit(3))} if weak else {}  # under a weak hash many different chunks collide
    got = exact_dedup.exact_dedup(df, **more).collect()
    groups = defaultdict(list)
    for i, t in EXACT:
        groups[lower(t)].append(i)
    want = sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in EXACT)
    assert sorted(map(tuple, got)) == want
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()}) == sorted({max(v) for v in groups.values()})


def test_the_pipeline_dedups_by_recipes(spark, monkeypatch):
    """Also where many different chunks collide, so that recipes alone don't tell texts apart."""
    calls, recipes = [], exact_dedup.recipes

    def weak(docs, id_col="doc_id", text_col="text", key=None):
        calls.append(id_col)
        return recipes(docs, id_col, text_col, lambda c: F.pmod(F.xxhash64(c), F.lit(3)))

    monkeypatch.setattr(exact_dedup, "recipes", weak)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in EXACT], f"{DOCS}, lang string, source string, n_chars long")
    got = corpus_pipeline.exact(spark, df, "")
    assert got.columns == df.columns
    groups = defaultdict(list)
    for i, t in EXACT:
        groups[lower(t)].append((i, t or ""))
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted(max(g) for g in groups.values())
    assert len(calls) == 1


def test_exact_null_ids_and_empty(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (3, "A"), (None, "b")], DOCS)).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name in ("op3_exact_dedup", "op5_mixing"):
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(map(tuple, got.collect())) == sorted(want.select(*[f'"{c}"' for c in got.columns]).fetchall())


# ---------------------------------------------------------------- SimHash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    votes = Counter()
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        votes.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k, n in votes.items() if 2 * n > len(s))


def test_fingerprints_in_parts():
    text = "  Ab\tc d\x0be " + " ".join(f"w{i % 97} É{i}" for i in range(5000))
    whole = np.concatenate(list(simhash.shingle_hashes(text)))
    parts = np.concatenate(list(simhash.shingle_hashes(text, most=1000)))
    assert (whole == parts).all()
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    for t in (None, "", " \n", "one", "one two", "a b c", "a b a b a b"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_codes_cover():
    table, costs = simhash.golay(2)
    assert (table == 0).sum() == 4096 and all((c[:, 0] >= 0).all() for c in costs[:1])
    rng = np.random.default_rng(0)
    fp = rng.integers(-(2**63), 2**63 - 1, 500)
    other = fp.copy()
    for k in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            other[k] ^= np.int64(np.uint64(1 << int(b)).astype(np.int64))
    for hot in (np.zeros(0, np.int64), np.unique(simhash._home(np.concatenate([fp, other])))):
        laid = defaultdict(set)
        for key, f, home in simhash._lay(np.concatenate([fp, other]), hot, 2):
            for a, b in zip(key.tolist(), f.tolist(), strict=True):
                laid[b].add((a, home))
        for a, b in zip(fp.tolist(), other.tolist(), strict=True):
            home = {k for k, h in laid[a] if h}
            assert len(home) == 1 and home & {k for k, _ in laid[b]}


def test_links_of_near_and_hot_points(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    near = [int(b) ^ (1 << int(k)) for b in base[:10] for k in rng.choice(62, 20)]
    fps = np.unique(np.array([*base.tolist(), *near], np.int64))
    d = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64))
    want = fold([(a, b) for a, b in np.argwhere(d <= 2).tolist() if a < b], range(len(fps)))
    for least_hot in (2048, 2):
        e = simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), least_hot=least_hot).collect()
        place = {int(f): k for k, f in enumerate(fps)}
        assert fold([(place[r.a], place[r.b]) for r in e], range(len(fps))) == want


def test_simhash_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    docs += [(1000, None), (1001, ""), (1002, "\n"), (1003, docs[0][1]), (1004, docs[0][1] + " one"), (1005, docs[1][1].upper())]
    got = {r.doc_id: r for r in simhash.simhash_dedup(spark.createDataFrame(docs, DOCS).withColumn("fp", F.lit(1))).collect()}
    fp = {i: slow_fingerprint(t) for i, t in docs}
    root = fold([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, DOCS)).collect()) == sorted(set(root.values()))


# ---------------------------------------------------------------- embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    near = [b + rng.standard_normal(64) * s for b, s in zip(base[:60], rng.uniform(0.05, 0.4, 60), strict=True)]
    hub = [base[0] + rng.standard_normal(64) * 0.05 for _ in range(40)]
    x = np.array([*base, *near, *hub, base[3], base[3]], np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None, *[1.0] * 63]), (1004, []), (1005, [float("inf")] * 64), (1006, [1.0, 2.0])]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T >= 0.95
    np.fill_diagonal(c, False)
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(spark.createDataFrame(data + bad, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(data) + len(bad)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.97 * c.sum() and all(got[i].n_links <= c[i].sum() for i in range(len(x)))
    root = fold([(a, b) for a, b in np.argwhere(c).tolist()], range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [500, 3000])
def test_recall_of_pairs_at_the_threshold(spark, n):
    rng = np.random.default_rng(n)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    base, c = unit(rng.standard_normal((n, 64))), rng.uniform(0.9501, 0.96, n // 3)[:, None]
    off = rng.standard_normal((n // 3, 64))
    off = unit(off - (off * base[: n // 3]).sum(1)[:, None] * base[: n // 3])
    x = np.concatenate([base, c * base[: n // 3] + np.sqrt(1 - c**2) * off])
    true = int((np.triu(x @ x.T, 1) >= 0.95).sum())
    got = embedding_dedup.near_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert true >= n // 3 and 0.96 * true <= sum(r.n_links for r in got) / 2 <= true


def test_embeddings_with_odd_rows(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a), (1, a), (None, a), (None, b), (7, b), (3, None), (3, None)], "vec_id long, embedding array<float>").withColumn("point", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 2 + [(None, 2, 1, False), (None, 1, 7, False), (7, 1, 7, True), (3, 0, 3, True), (3, 0, 3, True)], key=str)


def test_fingerprints_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "A B C"), (None, "a b c"), (None, None), (5, "")], DOCS).withColumn("id", F.lit(2))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in simhash.simhash_dedup(df).collect())
    assert got == Counter({(1, 1, True): 2, (None, 1, False): 1, (None, 5, False): 1, (5, 5, True): 1})


def test_hot_cells_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(64) + rng.standard_normal((300, 64)) * 0.05).tolist()
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "HOT_CELLS", 10**9)
    got = embedding_dedup.near_dedup(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}


# ---------------------------------------------------------------- substrings


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(4)
    docs = {i: words(rng, rng.randint(5, 200)) for i in range(60)}
    passages = [words(rng, 60) for _ in range(8)]
    planted = set()
    for k, p in enumerate(passages):
        for i in (k, k + 10, k + 20):
            w = docs[i].split()
            at = rng.randint(0, len(w))
            docs[i] = " ".join([*w[:at], p.upper() if i > 19 else p, *w[at:]])
            planted.add(i)
    docs[100] = docs[50]
    docs |= {101: None, 102: "", 103: "one two", 104: "du " * 500}
    got = substring_dedup.repeated_passages(spark.createDataFrame([*docs.items(), (None, docs[0])], DOCS).withColumn("first", F.lit(1))).collect()
    found = {r.doc_id for r in got}
    assert planted <= found
    assert found - planted - {50, 100, 104} == set()
    size = {(r.doc_id, r.first_word): r.n_words for r in got}

    def shingles(i, first):
        w = docs[i].lower().split()[first : first + size[i, first]]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for r in got:
        a, b = shingles(r.doc_id, r.first_word), shingles(r.cluster_doc, r.cluster_word)
        assert len(a & b) >= 0.8 * len(a | b)
        assert r.kept == ((r.doc_id, r.first_word) == (r.cluster_doc, r.cluster_word))
    assert substring_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_removal_keeps_one_occurrence(spark):
    rng = random.Random(8)
    p = words(rng, 80)
    docs = [(1, f"{words(rng, 30)} {p} {words(rng, 30)}", "a"), (2, f"{words(rng, 40)}\n{p} {words(rng, 20)}", "b"), (3, words(rng, 50), "c")]
    got = {r.doc_id: r for r in substring_dedup.remove(spark.createDataFrame(docs, "doc_id long, text string, more string")).collect()}
    assert got[1].text == docs[0][1] and got[3].text == docs[2][1] and got[2].more == "b"
    assert len(got[2].text.split()) < 85 and got[2].text.split()[:30] == docs[1][1].split()[:30]


def shingle_bytes(shingles):
    return np.unique(np.array(sorted(shingles), np.uint64)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


@pytest.mark.parametrize("together", [4096, 3])
def test_similar_paragraphs_are_linked_and_others_not(spark, together):
    rng = random.Random(9)
    sets = [{rng.getrandbits(40) for _ in range(30)} for _ in range(16)]
    sets.append(set(list(sets[0])[:28]) | {1, 2})  # 28 of 32: 0.875
    sets.append(set(list(sets[1])[:26]) | {3, 4, 5, 6})  # 26 of 34: 0.76
    sets.append(set(list(sets[2])[:29]) | {7})
    data = [(k, key, shingle_bytes(s)) for k, s in enumerate(sets) for key in (7, 7, -8)]
    e = substring_dedup.similar(spark.createDataFrame(data, "content long, key long, shingles binary"), 8, together=together).collect()
    assert {(r.a, r.b) for r in e} == {(0, 16), (2, 18)}


def test_long_texts_have_the_pieces_of_the_whole():
    rng = random.Random(21)
    lines = [words(rng, rng.choice([1, 4, 9, 40, 300])) for _ in range(200)] + ["du " * 700, words(rng, 2000)]
    text = "\n".join(lines).encode()
    whole = substring_dedup.Paragraphs([text])
    want = {(f, n, c) for f, n, c, line in zip(whole.first, whole.words, whole.content, whole.line, strict=True) if not line}
    told = {(f, n, c) for f, n, c, line in zip(whole.first, whole.words, whole.content, whole.line, strict=True) if line}
    for most in (900, 2500, 6000):
        got, lines_ = [], []
        for row, skip, texts, parts in substring_dedup.blocks([3], [text.decode()], most):
            p = substring_dedup.Paragraphs(texts, parts)
            for f, n, c, line in zip((p.first + skip[p.text]).tolist(), p.words, p.content, p.line, strict=True):
                (lines_ if line else got).append((f, n, c))
        assert len(got) == len(set(got)) and set(got) == want
        assert len(lines_) == len(set(lines_)) and {x for x in told if x[1] * 9 < most} <= set(lines_)


def test_paragraphs_do_not_depend_on_blocks():
    rng = random.Random(2)
    texts = [words(rng, n).encode() for n in (0, 3, 7, 400, 50, 1)]
    together = substring_dedup.Paragraphs(texts)
    for k, t in enumerate(texts):
        alone = substring_dedup.Paragraphs([t])
        mine = together.text == k
        assert (together.first[mine] == alone.first).all() and (together.content[mine] == alone.content).all()
    w, sizes = substring_dedup.word_hashes([b"a b  a\tb ", b"", b"b"])
    assert sizes.tolist() == [4, 0, 1] and w[0] == w[2] != w[1] == w[3] == w[4]


def test_short_and_long_lines_are_found_amid_other_text(spark):
    rng = random.Random(12)
    lines = [words(rng, n) for n in (5, 7, 11, 15, 20, 25, 30, 35, 40, 60) for _ in range(3)]
    docs = [(k, "\n".join([words(rng, 30), *[f"{t}\r\n{words(rng, 20)}" for t in lines]])) for k in range(3)]
    near = docs[2][1].replace(lines[-1], lines[-1].rsplit(" ", 2)[0] + " other end")  # 54 of 58 shingles
    docs[2] = (2, near)
    got = {(r.doc_id, r.first_word): r for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, DOCS)).where("line").collect()}
    at, want = 30, set()
    for t in lines:
        want |= {(d, at, len(t.split())) for d in range(3)}
        at += len(t.split()) + 20
    assert {(d, f, r.n_words) for (d, f), r in got.items()} == want
    assert all(r.cluster_doc == 0 and r.cluster_size == 3 and r.kept == (r.doc_id == 0) for r in got.values())
    left = {r.doc_id: r.text for r in substring_dedup.remove(spark.createDataFrame(docs, DOCS)).collect()}
    assert left[0] == docs[0][1] and len(left[1].split()) == 30 + 20 * len(lines) and 610 <= len(left[2].split()) < 700


def test_a_kept_piece_stays_in_a_line_that_goes(spark):
    rng = random.Random(13)
    common, mine = words(rng, 400), words(rng, 60)
    docs = [(1, common), (2, f"{common} {mine}"), (3, f"{words(rng, 60)} {mine} {words(rng, 50)}")]
    left = {r.doc_id: r.text for r in substring_dedup.remove(spark.createDataFrame(docs, DOCS)).collect()}
    shared = lambda t: {w for w in mine.split() if w in t.split()}
    assert left[1] == common and len(left[2].split()) < 80 and len(shared(left[2] + " " + left[3])) == len(set(mine.split()))


def test_passages_over_fifty_words_have_a_run_inside():
    rng = random.Random(14)
    for n, share in ((20, 0.2), (30, 0.8), (51, 0.999)):
        found = 0
        for _ in range(2000):
            p = words(rng, n)
            a, b = (substring_dedup.Paragraphs([f"{words(rng, 20)} {p} {words(rng, 20)}".encode()]) for _ in range(2))
            both = sorted({(f, m) for f, m, c, line in zip(a.first, a.words, a.content, a.line, strict=True) if not line and c in set(b.content[~b.line].tolist())})
            run = best = 0
            for k, (f, m) in enumerate(both):
                run = m + (run if k and both[k - 1][0] + both[k - 1][1] == f else 0)
                best = max(best, run)
            found += best >= substring_dedup.LEAST_WORDS
        assert found >= share * 2000, (n, found)


@pytest.mark.parametrize("keep_one", [exact_dedup.keep_one, simhash.keep_one])
def test_one_row_of_a_group_stays(spark, keep_one):
    rng = random.Random(15)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(7, a, 1), (7, b, 2), (9, b, 3), (2, c, 4), (2, c, 4), (None, d, 5), (None, d, 6), (None, a, 7)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, more long"))
    assert got.columns == ["doc_id", "text", "more"]
    kept = sorted(((r.text, r.doc_id) for r in got.collect()), key=str)
    assert kept == sorted([(a, 7), (b, 9 if keep_one is exact_dedup.keep_one else 7), (c, 2), (d, None)], key=str)

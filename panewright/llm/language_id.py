"""Language ID by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors, the first rolled by two places and the second by one; a text's vector
bundles (adds) those of its trigrams, and a language's prototype bundles those of its training
texts. A text gets the language whose prototype has the largest cosine with it.

Bundling is linear, so texts are counted first and each distinct trigram is bound once per block of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Letter classes: 0 stands for all that is no letter (runs of it count once), 1-26 for a-z, the others for further letters by a hash of their code point.
CLASSES = 128
SIZE = 512
SEED = 9
#: Characters of text that are worked on at once.
BLOCK = 1 << 20
NONE = "und"


@cache
def _letters() -> np.ndarray:
    """The class of each code point."""
    lower = np.arange(0x110000, dtype=np.int64)
    is_letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            is_letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    other = 27 + ((lower * 0x9E3779B1 & 0xFFFFFFFF) >> 13) % (CLASSES - 27)
    latin = (lower >= 97) & (lower <= 122)
    return np.where(is_letter, np.where(latin, lower - 96, other), 0).astype(np.uint8)


@cache
def _vectors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (CLASSES, SIZE)).astype(np.float32) * 2 - 1


def bind(grams: np.ndarray) -> np.ndarray:
    """The vector of each trigram, given as a number of three digits to base CLASSES."""
    v = _vectors()
    return np.roll(v, 2, axis=1)[grams // CLASSES**2] * np.roll(v, 1, axis=1)[grams // CLASSES % CLASSES] * v[grams % CLASSES]


def trigrams(text: str) -> np.ndarray:
    """The trigrams of text over runs of letters, each run with a non-letter before and after it."""
    c = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    return c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def _parts(text: str) -> Iterator[str]:
    """text in parts of at most BLOCK characters; a run of letters that a part's end cuts counts as two runs."""
    for at in range(0, max(1, len(text)), BLOCK):
        yield text[at : at + BLOCK]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text and how often it has them; none for a text without letters."""
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _parts(text or ""):
        g, k = np.unique(trigrams(part), return_counts=True)
        if len(grams):
            both, at = np.unique(np.concatenate([grams, g]), return_inverse=True)
            g, k = both, np.bincount(at, np.concatenate([n, k]).astype(float)).astype(np.int64)
        grams, n = g, k
    return grams, n


def _bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) for each text that has letters."""
    at = 0
    while at < len(texts):
        rows, got, held = [], [], 0
        while at < len(texts) and held < BLOCK:
            g, n = counts(texts[at])
            if len(g):
                rows.append(at)
                got.append((g, n))
            held += len(texts[at] or "") + 1
            at += 1
        if not rows:
            continue
        every, where = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
        bound = np.concatenate([bind(every[i : i + 8192]) for i in range(0, len(every), 8192)])
        start = 0
        for row, (g, n) in zip(rows, got, strict=True):
            yield row, n.astype(np.float32) @ bound[where[start : start + len(g)]]
            start += len(g)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype of length 1, from all rows with a language and letters.

    What each task sends is one vector a language, whatever the number of rows.
    """
    small_batches(train.sparkSession)

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for row, v in _bundles(b.column(0).to_pylist()):
                total[langs[row]] = total.get(langs[row], 0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    got = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    found = {r.lang: np.array([p.x for p in r.v]) for r in got.collect()}  # SIZE numbers a language
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns in keep, with lang_pred and score (the cosine, 0 at least); docs' columns of these two names can't be kept."""
    small_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), SIZE)
    d = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = d.columns.index(text_col)

    def score(batches):
        for b in batches:
            lang, best = [NONE] * b.num_rows, np.zeros(b.num_rows)
            for row, v in _bundles(b.column(at).to_pylist()):
                if names and (length := float(np.linalg.norm(v))) > 0:
                    cosine = matrix @ (v / length)
                    k = int(cosine.argmax())
                    lang[row], best[row] = names[k], min(1.0, max(0.0, float(cosine[k])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang), pa.array(best)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[: len(keep)])
    return d.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", split: Callable[[Column], Column] = held_out) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out and have a language; predicts all from text alone. A
    null text, one without letters and, if nothing could be learned, any text is `und` with
    score 0. Ties go to the first language by name. A null id is not held out.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", split(F.col("doc_id")))
    return predict(d, fit(d.where("not held_out")), ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")

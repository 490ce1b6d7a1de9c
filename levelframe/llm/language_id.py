"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a blank; the n-grams of one to three characters are hashed to
FEATURES places. A text's value at a place is its share of the text's n-grams times the place's inverse document
frequency, which is counted over all training documents. The weights are trained with follow-the-regularised-leader
and an elastic-net penalty on at most SAMPLE labelled documents (at most SAMPLE_PER_LANG of a language, the first by
hash; LEAST_PER_LANG of each where that makes more): that sample is the only bound. Every language is learned, and its features come to the driver as sparse counts. A temperature is fitted
on the part of the sample that was kept out of training. Predictions run over whole texts inside tasks.

Nulls and edge cases: a null text, or one without a letter, is und with score 0; without training rows every text is;
rows without doc_id are never training rows; repeated rows each get their row; a text of any length is read whole; of
languages with equal probability the first by name is taken; an empty table gives no rows; other columns are kept by
accepted() and ignored by predicted().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.llm.arena import chunks
from levelframe.llm.common import small_enough

FEATURES = 1 << 15
ORDERS = 3
SAMPLE, SAMPLE_PER_LANG, LEAST_PER_LANG = 2000, 400, 20
#: Languages whose weights are gathered at once.
LANGS_AT_ONCE = 64
#: Follow the regularised leader: step, its start, the penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.05, 6
#: Shares are small numbers: they are multiplied by this.
SCALE = 40.0
#: Documents below this probability are rejected by the pipeline.
ACCEPT = 0.5
#: Texts whose features are marked at once.
ROWS_AT_ONCE = 256


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def characters(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with letters lower-cased and the rest blank, offsets in code points)."""
    points = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE))
    letters = ((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xC0)
    return np.where(letters, points + np.uint32(32) * upper, np.uint32(32)), starts[offsets]


def places(points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each order, the place of the n-gram that starts at each character; FEATURES where the text ends before."""
    out, sums = [], np.zeros(len(points), np.uint32)
    for k in range(ORDERS):
        sums[: len(points) - k] += points[k:] * np.uint32((2654435761 * (2 * k + 1)) & 0xFFFFFFFF)
        mixed = (sums ^ (sums >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(k * 374761393 & 0xFFFFFFFF)
        at = ((mixed * np.uint32(3266489917)) >> np.uint32(17)).astype(np.int32)
        for j in range(1, k + 1):
            last = offsets[1:] - j
            at[last[last >= offsets[:-1]]] = FEATURES
        out.append(at)
    return out


def _document_frequencies(batches):
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for _, _, b, offsets in chunks(batch.column("text")):
            points, at = characters(b, offsets)
            found = places(points, at)
            for lo in range(0, len(at) - 1, ROWS_AT_ONCE):
                own = at[lo : lo + ROWS_AT_ONCE + 1]
                seen = np.zeros((len(own) - 1, FEATURES + 1), bool)
                row = np.repeat(np.arange(len(own) - 1), np.diff(own))
                for f in found:
                    seen[row, f[own[0] : own[-1]]] = True
                total += seen.sum(axis=0)
    hit = np.flatnonzero(total[:FEATURES])
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["place", "df"])


def _counts(batches):
    for batch in batches:
        at, n = [], []
        for _, _, b, offsets in chunks(batch.column("text")):
            points, own = characters(b, offsets)
            found = places(points, own)
            for lo, hi in zip(own[:-1], own[1:], strict=True):
                c = sum(np.bincount(f[lo:hi], minlength=FEATURES + 1) for f in found)[:FEATURES]
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "h", "at", "n"])


def train(rows: list, langs: list[str], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights by place and language with a last row for the bias, temperature) from (lang, h, at, n) rows."""
    # rows for the places that the sample has; all other weights stay zero
    used = np.unique(np.concatenate([np.asarray(r["at"], np.int64) for r in rows] + [np.array([FEATURES])]))
    z = np.zeros((len(used), len(langs)))
    n = np.zeros_like(z)
    number = {lang: j for j, lang in enumerate(langs)}

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    def values(r):
        at, c = np.asarray(r["at"], np.int64), np.asarray(r["n"], float)
        return np.searchsorted(used, np.append(at, FEATURES)), np.append(SCALE * c / max(c.sum(), 1.0) * idf[at], 1.0)

    def shares(logits):
        e = np.exp(logits - logits.max())
        return e / e.sum()

    rows = [(values(r), number[r["lang"]], r["h"] % 5 == 0) for r in sorted(rows, key=lambda r: r["h"])]
    for _ in range(PASSES):
        for (at, x), y, kept_out in rows:
            if kept_out:
                continue
            w = weights(at)
            p = shares(x @ w)
            p[y] -= 1.0
            g = np.outer(x, p)
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(len(used)))
    tests = [(x @ w[at], y) for (at, x), y, kept_out in rows if kept_out]
    loss = lambda t: -sum(np.log(max(shares(u / t)[y], 1e-12)) for u, y in tests)
    whole = np.zeros((FEATURES + 1, len(langs)), np.float32 if len(langs) > LANGS_AT_ONCE else np.float64)
    whole[used] = w
    return whole, min(np.geomspace(0.1, 10, 61), key=lambda t: (loss(t), t)) if tests else 1.0


class Model:
    """What a task needs to predict: weights times inverse document frequencies, bias, temperature, names."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.bias, self.temperature = langs, bias, temperature
        self.tables = [np.ascontiguousarray(table[:, j : j + LANGS_AT_ONCE]) for j in range(0, len(langs), LANGS_AT_ONCE)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, b, offsets in chunks(column, 1 << 20):
            points, own = characters(b, offsets)
            found = places(points, own)
            full = np.flatnonzero(np.diff(own))
            sums, total = np.zeros((len(own) - 1, len(self.langs))), np.zeros(len(own) - 1)
            for f in found:
                if len(full):
                    for k, table in enumerate(self.tables):
                        at = k * LANGS_AT_ONCE
                        sums[full, at : at + table.shape[1]] += np.add.reduceat(table[f], own[:-1][full], axis=0, dtype=np.float64)
                    total[full] += np.add.reduceat(f < FEATURES, own[:-1][full], dtype=np.int64)
            logits = (SCALE * sums / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            letters = np.zeros(len(own) - 1, bool)
            letters[full] = np.logical_or.reduceat((points >= 97) & (points <= 122), own[:-1][full]) if len(full) else False
            for k in np.flatnonzero(~letters):  # the rare rest: ask each character
                letters[k] = any(c.isalpha() for c in b[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
            best = p.argmax(axis=1)
            names += [self.langs[j] if ok else "und" for j, ok in zip(best, letters, strict=True)]
            scores.append(np.where(letters, p.max(axis=1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fitted(docs: DataFrame) -> Model | None:
    """Train on the documents with text and lang that are not held out; None without any."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not counts:
        return None
    langs, rows = sorted(r["lang"] for r in counts), sum(r["n"] for r in counts)
    per_lang = max(LEAST_PER_LANG, min(SAMPLE_PER_LANG, SAMPLE // len(langs)))
    h = F.xxhash64(F.lit("language sample"), "doc_id", F.crc32("text"))
    keyed = own.select("lang", "doc_id", h.alias("h"))
    chosen = keyed.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= per_lang).select("lang", "doc_id", "h").distinct()
    # few small rows: broadcast, so that only their texts move
    texts = own.select("lang", "doc_id", "text", h.alias("h")).join(small_enough(chosen), ["lang", "doc_id", "h"]).select("lang", "h", "text")
    sample = texts.mapInArrow(_counts, "lang string, h long, at array<int>, n array<int>").collect()
    frequencies = own.select("text").mapInArrow(_document_frequencies, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()  # FEATURES rows
    df = np.zeros(FEATURES)
    for r in frequencies:
        df[r["place"]] = r["df"]
    idf = np.log((1 + rows) / (1 + df)) + 1
    w, temperature = train([r.asDict() for r in sample], langs, idf)
    table = np.zeros((FEATURES + 1, len(langs)), np.float32)
    table[:FEATURES] = w[:FEATURES] * idf[:, None]
    return Model(langs, table, w[FEATURES], temperature)


def prediction(model: Model | None) -> Column:
    """A column struct(lang, score) of the column text."""
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores = model.predict(text)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(F.col("text"))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    model = fitted(docs)
    return docs.select("doc_id", held_out().alias("held_out"), prediction(model).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose text has a learned language with probability ACCEPT or more, all columns."""
    names = docs.columns
    model = fitted(docs)
    rows = docs.select(F.struct(*names).alias("__row"), "text").select("__row", prediction(model).alias("__p"))
    return rows.filter((F.col("__p.lang") != "und") & (F.col("__p.score") >= ACCEPT)).select("__row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return predicted(table(spark, sf_dir, "documents"))

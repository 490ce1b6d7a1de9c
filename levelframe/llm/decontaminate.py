"""Benchmark decontamination: find benchmark passages in documents, and remove the words or the documents.

Benchmark items become windows of ten consecutive words (an item of fewer words is one window). A bit filter of
their hashes, sized by their number, drops almost all windows of the documents inside the row; the few that pass are
carried as text into an exact join with the set of windows, which is broadcast while its bytes are few enough. Only
rows with possible hits are shuffled, however common a passage is; the rest is read back from a saved table.

Nulls and edge cases: null or empty texts have no words and no hits; a text of any length is read whole; an empty
benchmark hits nothing; repeated rows are judged one by one; a window that several items share counts for each of
them, and of overlapping windows every word counts once; a null item_id names no item; columns other than doc_id,
text, item_id are ignored by the report and kept by the removal, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.llm.common import BitFilter, ascii_lower, let, saved, small_enough, upto, window_hashes, words_of, written

NGRAM = 10
#: Words are what lies between these: ASCII characters that are neither letters nor digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = "struct<pos:int,len:int,gram:string>"


def normalised(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATOR)


def windows(words: Column, hashes: dict[int, Column], wanted) -> Column:
    """All windows of the given sizes whose hash is wanted, as (pos, len, gram)."""

    def of(size: int, hashes: Column) -> Column:
        picked = let(hashes, lambda h: F.filter(upto(F.size(h)), lambda i: wanted(h[i])))
        return F.transform(picked, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.array_join(F.slice(words, i + 1, size), " ").alias("gram")))

    return F.concat(*(of(size, h) for size, h in hashes.items()))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, len, gram, hash) of each distinct window of the items."""
    worded = benchmark.select("item_id", normalised(F.col("text")).alias("words"))
    n = F.size("words")
    spans = F.when(n >= NGRAM, F.transform(upto(n - NGRAM + 1), lambda i: F.slice("words", i + 1, NGRAM))).when(n > 0, F.array(F.col("words")))
    grams = worded.select("item_id", F.explode(spans).alias("span")).select(
        F.col("item_id").cast("string").alias("item_id"), F.size("span").alias("len"), F.array_join("span", " ").alias("gram"), "span"
    )
    return grams.dropDuplicates(["item_id", "len", "gram"])


def with_hash(grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds the hash that a document's window of the same words gets."""
    def of(words):
        return window_hashes(words, sizes, lambda hashes: F.coalesce(*(F.when(F.size(words) == size, h[0]) for size, h in hashes.items())))

    return grams.withColumn("hash", let(F.col("span"), of))


def hit_rows(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of docs with n_words, n_hit, items (sorted ids of the items with occurring windows), spans.

    keep should be few short columns: they are saved beside what is found. Only rows with a possible hit are shuffled.
    """
    grams = benchmark_windows(benchmark)
    sizes = sorted(r["len"] for r in grams.select("len").distinct().collect())  # ten numbers at most
    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), *keep, normalised(F.col("text")).alias("__words"))
    if not sizes:
        none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<a:int,b:int>>")}
        return rows.select(*keep, F.size("__words").cast("long").alias("n_words"), *(c.alias(k) for k, c in none.items()))
    grams = saved(with_hash(grams, sizes).select("item_id", "len", "gram", "hash"))
    listed_hashes = BitFilter(grams, "hash", constant=True)

    def found(words: Column) -> Column:
        return window_hashes(words, sizes, lambda hashes: windows(words, hashes, listed_hashes.may_hold))

    slim = written(rows.select("__rid", *keep, F.size("__words").cast("long").alias("n_words"), let(F.col("__words"), found).alias("__found")))
    listed = small_enough(grams.select("item_id", "len", "gram"))
    possible = slim.filter(F.size("__found") > 0).select("__rid", F.explode("__found").alias("f")).select("__rid", "f.pos", "f.len", "f.gram")
    hits = possible.join(listed, ["gram", "len"]).select("__rid", "item_id", F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("len")).alias("b")).alias("span"))
    grouped = saved(hits.groupBy("__rid").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items")))
    # the union of the spans: what each adds beyond the end so far
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    out = slim.drop("__found").join(small_enough(grouped), "__rid", "left")
    return out.select(
        *keep, "n_words", F.coalesce(union["n"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: how many words, hits, items, and whether it is contaminated."""
    return hit_rows(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _text_key() -> Column:
    return F.unhex(F.sha2("text", 256))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    What is found depends on the text alone: rows go if a contaminated text has the same digest.
    """
    bad = saved(hit_rows(docs.select(_text_key().alias("__k"), "text"), benchmark, ["__k"]).filter("n_hit > 0").select("__k").distinct())
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), _text_key().alias("__t"))
    return keyed.join(small_enough(bad), F.col("__t") == F.col("__k"), "left_anti").select("__row.*")


def with_spans_removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with every word inside a benchmark window taken out; a changed text is its words, normalised
    and joined by spaces, other texts stay as they are."""
    names = docs.columns
    hit = hit_rows(docs.select(_text_key().alias("__k"), "text"), benchmark, ["__k"]).filter("n_hit > 0")
    hit = saved(hit.groupBy("__k").agg(F.first("spans").alias("__spans")))  # equal texts have equal spans
    rows = docs.select(F.struct(*names).alias("__row"), _text_key().alias("__t")).join(small_enough(hit), F.col("__t") == F.col("__k"), "left")
    inside = lambda i: F.exists("__spans", lambda s: (i >= s["a"]) & (i < s["b"]))
    kept = let(normalised(F.col("__row.text")), lambda w: F.array_join(F.filter(w, lambda x, i: ~inside(i)), " "))
    text = F.when(F.col("__spans").isNotNull(), kept).otherwise(F.col("__row.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

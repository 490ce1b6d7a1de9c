"""Quality rules whose limits come from the corpus, by language and source.

Each document gets counts (words, symbols, repeated lines, repeated word triples). For every language and source a
mergeable quantile sketch of each ratio counts the documents in bins whose edges grow by GROWTH, so that a quantile is
known to that relative error; counts add up exactly, so that a rerun has the same limits. The limit of a ratio is its
quantile at 1 - TAIL in the group, weighed with the corpus's by PRIOR documents, so that small groups lean on the corpus
smoothly. Values over GROSS are junk whatever the group: they are left out of the quantile, which junk so can't raise,
and no limit lies above. No limit lies below LEAST either, a few odd places that any text may have; for the length of
words LEAST is in medians of the group. Limits come back to the documents by a join.

A sketch has at most some thousand bins and merges on the map side, so that a source with a third of all rows costs its
tasks no more than any other.

Nulls and edge cases: a null text has no words and fails the base rules; an empty text likewise; a null language or
source is a group of its own; a document at the limit is kept, as are all documents of a ratio that all share; a text of
any length is read whole; an empty table gives no rows. Rows are judged one by one, so that repeated rows each get a
result and each count; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.llm.common import let, saved, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The share of a group's documents that may lie above a limit, and how many documents the corpus counts as beside a group.
TAIL, PRIOR = 0.01, 100
#: Edges of the sketches' bins grow by this factor.
GROWTH = 1.02
#: Junk whatever the group; the length of words has no such bound, as languages differ.
GROSS = {"symbol_ratio": 0.20, "dup_line_ratio": 0.25, "repeat_ratio": 0.25, "long_word": None}
#: No limit lies below; of the length of words in medians.
LEAST = {"symbol_ratio": 0.02, "dup_line_ratio": 0.10, "repeat_ratio": 0.10, "long_word": 1.3}
RATIOS = list(GROSS)
#: The bin of zero, below all others.
ZERO = -1_000_000


def repeated_triples(words: Column) -> Column:
    """Words inside windows of three that occur twice or more: sort the windows' hashes, keep equal neighbours,
    and add up the cover of their positions."""

    def cover(at: Column) -> Column:
        # each window covers three words, fewer if the next one starts before its end
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

    def equal_neighbours(ranked: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ranked)
        flagged = F.zip_with(
            F.zip_with(before, ranked, lambda a, b: F.struct(b.alias("b"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("left"))),
            F.slice(ranked, 2, F.size(ranked)),
            lambda x, c: F.when(x["left"] | F.coalesce(x["b"]["h"] == c["h"], F.lit(False)), x["b"]["i"]),
        )
        return let(F.array_sort(F.filter(flagged, lambda i: i.isNotNull())), cover)

    def ranked(w: Column) -> Column:
        triples = F.zip_with(
            F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.slice(w, 3, F.size(w)),
            lambda x, c: F.xxhash64(x["a"], x["b"], c),
        )
        whole = F.slice(triples, 1, F.size(w) - 2)
        return let(F.array_sort(F.transform(whole, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), equal_neighbours)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(ranked(words))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_triples(w).cast("long").alias("n_repeat_words")))
    more = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        *keep,
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        counts.alias("__w"),
        more.alias("__l"),
    ).select(*keep, "__w.n_words", "word_chars", "n_symbols", "__l.n_lines", "__l.n_dup_lines", "__w.n_repeat_words")


def with_ratios(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    return counts.withColumns(
        {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "long_word": share("word_chars", "n_words")}
    )


def sketches(measures: DataFrame) -> DataFrame:
    """__lang, __source, ratio, bin, n: the documents with words by bins of each ratio."""
    bin_of = lambda r: F.when(F.col(r) <= 0, ZERO).otherwise(F.ceil(F.round(F.log(r) / math.log(GROWTH), 6)).cast("int"))
    small = lambda r: F.lit(True) if GROSS[r] is None else F.col(r) <= GROSS[r]
    entries = F.array(*(F.when(small(r), F.struct(F.lit(r).alias("ratio"), bin_of(r).alias("bin"))) for r in RATIOS))
    rows = measures.filter("n_words > 0").select("__lang", "__source", F.explode(entries).alias("e")).filter("e IS NOT NULL")
    return rows.groupBy("__lang", "__source", "e.ratio", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, high, middle: the quantiles at 1 - TAIL and a half from the bins of each key, at most some thousand."""
    by = W.partitionBy(*keys)
    upto, total = F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), F.sum("n").over(by)
    rows = bins.withColumns({"__upto": upto, "__total": total})
    value = F.when(F.col("bin") == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bin")))
    at = lambda p: F.min(F.when(F.col("__upto") >= p * F.col("__total"), value))
    return rows.groupBy(*keys).agg(F.first("__total").alias("total"), at(1 - TAIL).alias("high"), at(0.5).alias("middle"))


def fences(measures: DataFrame) -> DataFrame:
    """The limits of each ratio by language and source: __lang, __source, max_<ratio>.

    The corpus's bins are merged from the groups'.
    """
    bins = saved(sketches(measures))
    whole = quantiles(bins.groupBy("ratio", "bin").agg(F.sum("n").alias("n")), ["ratio"]).select("ratio", F.col("high").alias("all_high"), F.col("middle").alias("all_middle"))
    own = quantiles(bins, ["__lang", "__source", "ratio"]).join(F.broadcast(whole), "ratio")  # a row a ratio
    lean = lambda mine, corpus: (F.col("total") * F.col(mine) + PRIOR * F.col(corpus)) / (F.col("total") + PRIOR)
    least = F.coalesce(*(F.when(F.col("ratio") == r, LEAST[r] * lean("middle", "all_middle") if GROSS[r] is None else F.lit(LEAST[r])) for r in RATIOS))
    gross = F.coalesce(*(F.when(F.col("ratio") == r, F.lit(GROSS[r])) for r in RATIOS if GROSS[r] is not None), F.lit(float("inf")))
    limit = F.least(F.greatest(lean("high", "all_high"), least), gross)
    limits = own.select("__lang", "__source", "ratio", limit.alias("limit"))
    return limits.groupBy("__lang", "__source").agg(*(F.max(F.when(F.col("ratio") == r, F.col("limit"))).alias(f"max_{r}") for r in RATIOS))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the counts, base_failed and kept for each row of docs (text, lang, source)."""
    own = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("__lang"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__source")
    # the counts take one pass over the texts and are used twice
    counts = with_ratios(saved(measured(docs.select(*keep, "text", *own), [*keep, "__lang", "__source"])))
    limits = fences(counts)
    bad = F.lit(False)
    for r in RATIOS:
        # without a limit all of the group is gross
        bad = bad | (F.col(r) > F.coalesce(f"max_{r}", F.lit(GROSS[r] if GROSS[r] is not None else float("inf"))))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.join(limits, ["__lang", "__source"], "left").withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the fences of their language and source."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("__row"), "text", "lang", "source")
    return judged(held, ["__row"]).filter("kept").select("__row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    docs = table(spark, sf_dir, "documents")
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

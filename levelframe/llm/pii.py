"""Personal data: base patterns, and terms of the corpus that give a protected value away.

The base finds e-mail and IP addresses, card and phone numbers. Their values are the protected entities, and so are
the groups that values share: an e-mail's domain, an address's network, a card's issuer range, a phone's first digits;
single values seldom recur, their groups do. For each term near an entity the corpus tells how strongly it reveals it: P(entity | term) is the share of the distinct texts
with the term in which it stands within CONTEXT words of the entity, and its disclosure is log2 of that over
P(entity). Terms seen with an entity in MIN_TEXTS texts or more, with enough bits, are generalised from
P(entity | term) = GENERALISE on and removed from REMOVE on, wherever they occur.

Only texts with an entity take part in the pairs, and only terms that survive the support test and stand mostly
beside their entity, as far as texts with entities tell, are looked for in the corpus: a fixed-size bit filter picks them inside the row, an exact join confirms them. Everything is counted by
distinct text, so that copies neither add evidence nor gather anywhere.

A term is a run of letters and digits of any length; what stands between two matches is read whole.

Nulls and edge cases: a null or empty text has no spans; a text of any length is read whole; of terms that start at
the same place each is a span; a term's strength is its highest for any entity; repeated rows each get their row; equal texts get equal
spans; overlapping matches of different kinds all count; terms inside a base span are left out; an empty
table gives no rows and no terms; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.llm.common import BitFilter, ascii_lower, let, prefix_sums, saved, small_enough, upto, words_of

#: Fixed patterns. The look-behinds and possessive repeats leave the matches as they are and keep long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 6
MIN_TEXTS = 3
MIN_BITS = 6.0
GENERALISE, REMOVE = 0.5, 0.8
#: What separates terms.
NOT_TERM = r"[^\p{L}\p{N}]"
SPAN = "struct<start:int,kind:int,end:int,value:string,terms:array<string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets_fit(value: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(999)) <= 255))


def _card_fits(value: Column) -> Column:
    n = F.length(_digits(value))
    return (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(value))


def _phone_fits(value: Column) -> Column:
    n = F.length(_digits(value))
    return (n >= 10) & (n <= 15)


def _terms(piece: Column, last: bool) -> Column:
    """The terms among the CONTEXT last or first words of what stands beside a match."""
    words = words_of(piece)
    near = F.when(F.size(words) <= CONTEXT, words).when(F.lit(last), F.slice(words, -CONTEXT, CONTEXT)).otherwise(F.slice(words, 1, CONTEXT))
    return F.array_remove(F.split(F.array_join(F.transform(near, ascii_lower), " "), NOT_TERM), "")


def _matches(text: Column, pattern: str, kind: int, fits, terms: bool) -> Column:
    """Spans of the leftmost matches of a pattern, without those that do not fit."""
    empty = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        def spans(pieces: Column) -> Column:
            def built(ends: Column) -> Column:
                def one(v: Column, i: Column) -> Column:
                    near = F.array_distinct(F.concat(_terms(pieces[i], True), _terms(pieces[i + 1], False))) if terms else F.array().cast("array<string>")
                    return F.struct((ends[i] - F.length(v)).alias("start"), F.lit(kind).alias("kind"), ends[i].alias("end"), v.alias("value"), near.alias("terms"))

                return F.filter(F.transform(found, one), lambda s: fits(s["value"]))

            lengths = F.transform(found, lambda v, i: F.length(pieces[i]) + F.length(v))
            return let(prefix_sums(lengths), built)

        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), spans))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def base_spans(text: Column, terms: bool = False) -> Column:
    """All base spans of a text, by start and kind; terms: each with the terms around it."""
    empty = F.array().cast(f"array<{SPAN}>")
    always = lambda v: F.lit(True)
    return F.array_sort(
        F.concat(
            F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0, always, terms)).otherwise(empty),
            _matches(text, IP, 1, _octets_fit, terms),
            _matches(text, CARD, 2, _card_fits, terms),
            F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, 3, _phone_fits, terms)).otherwise(empty),
        )
    )


def _entities(s: Column) -> Column:
    """The entities of a span: its value, and the group that it belongs to."""
    value, kind = F.lower(s["value"]), s["kind"]
    group = (
        F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2))
        .when(kind == 2, F.substring(_digits(value), 1, 6)).otherwise(F.substring(_digits(value), 1, 4))
    )
    return F.array(F.xxhash64(kind, value), F.xxhash64(kind, F.lit("group"), group))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__x"), F.crc32(text).alias("__c"), F.length(text).alias("__n")]


KEY = ["__x", "__c", "__n"]


def disclosing_terms(texts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(occurrences, terms): where candidate terms stand in each distinct text, and the terms that disclose, with
    their highest P(entity | term). None if no term has the support.

    texts: column __t and key; spans: key and base spans.
    """
    pairs = spans.filter(F.size("spans") > 0).select(*KEY, F.explode("spans").alias("s")).select(*KEY, F.explode(_entities(F.col("s"))).alias("entity"), "s.terms").select(*KEY, "entity", F.explode("terms").alias("term"))
    entities = spans.filter(F.size("spans") > 0).select(*KEY, F.explode(F.flatten(F.transform("spans", _entities))).alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = saved(pairs.distinct())
    # texts with the term beside any entity: P(entity | term) is at most n_te over that, so that frequent words drop out
    beside = pairs.select(*KEY, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_beside"))
    support = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= MIN_TEXTS)
    support = support.join(beside, "term").filter(F.col("n_te") >= GENERALISE * F.col("n_beside")).drop("n_beside")
    support = saved(support.join(entities, "entity").withColumn("hash", F.xxhash64("term")))
    if support.isEmpty():
        return None
    listed = BitFilter(support, "hash", constant=True)
    candidates = support.select(F.col("term").alias("__term")).distinct()

    def located(tokens: Column) -> Column:
        def placed(at: Column) -> Column:
            lengths = F.transform(tokens, lambda w: F.length(w) + 1)
            return F.when(F.size(at) == 0, F.array().cast("array<struct<term:string,start:int>>")).otherwise(
                let(prefix_sums(lengths), lambda ends: F.transform(at, lambda i: F.struct(tokens[i].alias("term"), (ends[i] - 1 - F.length(tokens[i])).alias("start"))))
            )

        return let(F.filter(upto(F.size(tokens)), lambda i: (tokens[i] != "") & listed.may_hold(F.xxhash64(tokens[i]))), placed)

    seen = texts.select(*KEY, F.explode(let(F.split(ascii_lower(F.col("__t")), NOT_TERM, -1), located)).alias("o")).select(*KEY, "o.term", "o.start")
    seen = seen.join(small_enough(candidates), F.col("term") == F.col("__term"), "left_semi")
    occurrences = saved(seen.groupBy(*KEY, "term").agg(F.collect_set("start").alias("starts")))
    total = spans.select(*KEY).distinct().count()
    per_term = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    p = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    bits_of = F.log2(p / (F.col("n_e") / F.lit(float(max(total, 1)))))
    terms = support.join(per_term, "term").filter((p >= GENERALISE) & (bits_of >= MIN_BITS)).groupBy("term").agg(F.max(p).alias("p"))
    return occurrences, terms


def annotated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and all spans of each row's text: array of (start, kind, end, value, strength), kind as in KINDS.

    strength: null for base spans, P(entity | term) for terms.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("__t"))
    spans = saved(rows.select(*keep, *_key(F.col("__t")), base_spans(F.col("__t"), terms=True).alias("spans")))
    found = disclosing_terms(rows.select("__t", *_key(F.col("__t"))), spans)
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("double").alias("strength")))
    if found is None:
        return spans.select(*keep, base.alias("spans"))
    occurrences, terms = found
    extra = (
        occurrences.join(terms, "term")
        .select(*KEY, F.explode(F.transform("starts", lambda a: F.struct(a.alias("start"), F.lit(4).alias("kind"), (a + F.length("term")).cast("int").alias("end"), F.col("term").alias("value"), F.col("p").alias("strength")))).alias("t"))
        .groupBy(*KEY)
        .agg(F.collect_list("t").alias("__terms"))
    )
    free = F.filter(F.coalesce("__terms", F.array().cast("array<struct<start:int,kind:int,end:int,value:string,strength:double>>")), lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return spans.join(extra, KEY, "left").select(*keep, F.array_sort(F.concat(base, free)).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by their kind in brackets, disclosing terms by [TERM] or, if strong, by nothing."""
    names = docs.columns
    rows = annotated(docs.select(F.struct(*names).alias("__row"), "text"), ["__row"])
    text = F.coalesce(F.col("__row.text"), F.lit(""))
    names_of = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))

    def put(s: Column, x: Column) -> Column:
        word = F.when(F.coalesce(x["strength"] >= REMOVE, F.lit(False)), F.lit("")).otherwise(names_of[x["kind"]])
        gap = F.when(x["start"] >= s["end"], F.concat(F.substring(text, s["end"] + 1, x["start"] - s["end"]), word)).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], gap).alias("out"), F.greatest(s["end"], x["end"]).alias("end"))

    clean = F.aggregate("spans", zero, put, lambda s: F.concat(s["out"], F.substring(text, s["end"] + 1, F.length(text))))
    return rows.select(*(F.when(F.size("spans") > 0, clean).otherwise(F.col("__row.text")).alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names))


def report(docs: DataFrame) -> DataFrame:
    """Counts of each base kind and digests of the spans of each row."""
    spans = annotated(docs, ["doc_id"])
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(4).alias("n_term"),
    )


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return report(table(spark, sf_dir, "documents"))

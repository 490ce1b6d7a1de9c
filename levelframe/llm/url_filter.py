"""URL filters: a blocked Bloom filter of listed keys, and an exact join behind it.

Two lists are looked up. Rules have a host and a path prefix and fit the host with all its subdomains: each url asks
for its host suffixes joined with its path prefixes, in the few shapes (labels, prefix length) that the rules have.
Listed urls are canonical: without scheme, www. or m., port, query, fragment, ending slash or .html; a url without a
rule asks for its canonical form. Every question goes through the Bloom filter, whose blocks are 64-bit words, and
the possible hits through a join on the key itself, which removes the false positives.

Nulls and edge cases: a null url, or one without ://, has an empty host and path and is allowed; repeated rows each
get their row; a url of any length is read whole; empty tables give empty results; columns that
are not to be kept are ignored, whatever their names; of two rules the longer one wins, then the one that blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.llm.common import ascii_lower, saved, small_enough

#: Host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Bits that each key sets in its block, and bits of the filter for each key.
PROBES, BITS_PER_KEY = 4, 16


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, host, path and canonical url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    canonical = F.concat(F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), ":[0-9]*$", ""), F.regexp_replace(path, r"(?:\.html|/)$", ""))
    return pages.select(*keep, host.alias("host"), path.alias("path"), F.when(host != "", canonical).alias("canonical"))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: str) -> Column:
    """PROBES bits of a 64-bit word, by a second hash."""
    h = F.xxhash64(F.lit("mask"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int")) for k in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of a column key as rows (block, word), for about n keys."""
    blocks = max(1, n * BITS_PER_KEY // 64)
    return keys.groupBy(_block("key", blocks).alias("block")).agg(F.bit_or(_mask("key")).alias("word")), blocks


def listed_hits(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of asked (key, ..) whose key is listed (key, ..), with both sides' columns: the filter, then the join."""
    listed = saved(listed)
    words, blocks = bloom(listed, max(listed.count(), 1))
    possible = asked.withColumn("block", _block("key", blocks)).join(small_enough(words), "block").filter(F.col("word").bitwiseAND(_mask("key")) == _mask("key")).drop("block", "word")
    return possible.join(small_enough(listed), "key")


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (__rid, host, path, ..) with rule and rule_verdict, null where none fits."""
    spark = urls.sparkSession
    listed = spark.createDataFrame([(h + p, v, len(h + p)) for h, p, v in rules], "key string, rule_verdict string, length int")
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    questions = F.array(*(F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)) for n, m in shapes))
    asked = urls.filter("host <> ''").select("__rid", F.explode(F.array_distinct(questions)).alias("key"))
    best = listed_hits(asked, listed).groupBy("__rid").agg(F.max(F.struct("length", "rule_verdict", "key")).alias("best"))
    return urls.join(best, "__rid", "left").withColumns({"rule": F.col("best.key"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def filtered(pages: DataFrame, keep: list[str], rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """keep, host, path, rule and verdict of each page. listed: canonical urls to block, in a column key; without
    it, the canonical urls of all pages that a rule blocks, so that their other spellings are blocked as well."""
    urls = saved(parsed(pages.withColumn("__rid", F.monotonically_increasing_id()), ["__rid", *keep]))
    found = saved(ruled(urls, rules))
    if listed is None:
        listed = found.filter("rule_verdict = 'block'").select(F.col("canonical").alias("key")).distinct()
    asked = found.filter("rule IS NULL AND canonical IS NOT NULL").select("__rid", F.col("canonical").alias("key"))
    hits = listed_hits(asked, listed).select("__rid", F.lit("block").alias("list_verdict")).distinct()
    verdict = F.coalesce("rule_verdict", "list_verdict", F.lit("allow"))
    return found.join(hits, "__rid", "left").select(*keep, "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return filtered(table(spark, sf_dir, "pages"), ["page_id"])


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':[0-9]*$', '') || regexp_replace(path, '(?:\.html|/)$', '') END AS canonical FROM u),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
),
listed AS (SELECT DISTINCT canonical FROM c JOIN best USING (page_id) WHERE v = 'block')
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.v, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (page_id) LEFT JOIN listed ON c.canonical = listed.canonical
"""

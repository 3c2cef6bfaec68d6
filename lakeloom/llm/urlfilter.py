"""URL filters: host and path rules, and a blocked Bloom filter in front of an exact join with listed URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Runs of three symbols, and how many of them in a page's html put its URL on the list of this repository's query.
JUNK, LEAST_JUNK = "#{3}|[*]{3}|%{3}|[$]{3}", 8
#: Bits that a URL sets in its 64-bit block, listed URLs per block on average, and most bytes of a filter that is broadcast.
BITS, PER_BLOCK, BROADCAST_BYTES = 4, 4, 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_FILE = "/index\\.(html?|php)\\z"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, tried from the longest to the shortest; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    out = None
    for verdict, h, p in ordered:
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits(h, p), value) if out is None else out.when(fits(h, p), value)
    return out


def canonical(host: Column, path: Column) -> Column:
    """One spelling for URLs of the same page: no scheme, query, fragment, leading ``www.``, index file or final slash."""
    plain = F.regexp_replace(F.regexp_replace(path, INDEX_FILE, "/"), "/+\\z", "")
    return F.concat(F.regexp_replace(host, "^www\\.", ""), plain)


def _mask(hashed: Column) -> Column:
    """The bits that a URL sets in its block, from disjoint six-bit groups of its hash."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter as a table: ``_block`` and its 64 ``_bits``. A URL touches one block only.

    The block comes from one hash, the bits in it from another. One row per block that is not empty.
    """
    hashed = F.xxhash64("canonical", F.lit(1))
    return listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("_block"), _mask(hashed).alias("_m")).groupBy("_block").agg(F.bit_or("_m").alias("_bits"))


def match_listed(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (with a column ``canonical``) with boolean ``listed``: exact membership in ``listed.canonical``.

    The Bloom filter passes possible hits; only these meet the list, in an exact hash join that removes false
    positives. The filter is broadcast while its size (16 bytes a block, counted beforehand) is under
    ``BROADCAST_BYTES``, and joined by block otherwise. The list is unique by URL, so that no row multiplies; a URL that
    many pages share is a hot key on the large side only, which Spark's skew join splits. Null URLs are not listed.
    """
    listed = materialize(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct(), "listed-urls")
    blocks = max(1, listed.count() // PER_BLOCK)
    bloom = bloom_filter(listed, blocks)
    if blocks * 16 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    hashed = F.xxhash64("canonical", F.lit(1))
    probed = urls.withColumn("_block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))).join(bloom, "_block", "left")
    mask = _mask(hashed)
    possible = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    # only possible hits keep their key; all others get a number that no listed URL has, which spreads them
    spread = F.when(possible, F.lit(-1)).otherwise(F.monotonically_increasing_id())
    keyed = probed.withColumn("_possible", F.when(possible, F.col("canonical")).otherwise("")).withColumn("_spread", spread).drop("_block", "_bits")
    exact = listed.select(F.col("canonical").alias("_possible"), F.lit(-1).cast("long").alias("_spread"), F.lit(True).alias("_hit"))
    both = keyed.join(exact.hint("shuffle_hash"), ["_possible", "_spread"], "left")
    return both.withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("_possible", "_spread", "_hit")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``canonical`` and ``listed``: the longest rule that fits decides; a page without one
    is blocked if its canonical URL is listed, and allowed otherwise.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are not listed. Columns of ``pages`` by
    the six names are replaced, others stay; repeated rows are judged alike; an empty table gives an empty one.
    """
    own = ("host", "path", "rule", "verdict", "canonical", "listed")
    host, path = split_url(F.col("url"))
    packed = pages.select(F.struct(*pages.columns).alias("_page"), host.alias("host"), path.alias("path"))
    parsed = packed.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    judged = match_listed(parsed, listed)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    kept = [F.col(f"_page.`{c}`").alias(c) for c in pages.columns if c not in own]
    return judged.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), method).alias("verdict"), "canonical", "listed")


def listed_by_content(pages: DataFrame, pattern: str = JUNK, least: int = LEAST_JUNK) -> DataFrame:
    """A list of canonical URLs: those under which some page has at least ``least`` matches of ``pattern`` in its html. All spellings of a URL are listed then."""
    host, path = split_url(F.col("url"))
    found = pages.where(F.regexp_count("html", F.lit(pattern)) >= least).select(host.alias("host"), path.alias("path")).where("host <> ''")
    return found.select(canonical(F.col("host"), F.col("path")).alias("canonical"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: rule and verdict for the URL of every page; the list is made from what the pages hold."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), listed_by_content(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE_OP2 = """
WITH u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS a FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(regexp_replace(path, '/index\\.(html?|php)$', '/'), '/+$', '') AS canonical,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE host <> '' AND len(regexp_extract_all(html, '#{3}|[*]{3}|%{3}|[$]{3}')) >= 8)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN l USING (canonical)
"""

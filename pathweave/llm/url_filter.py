"""URL filter: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 32-bit words in a block, and bits that a key sets in its block.
WORDS, BITS = 8, 6
#: The filter takes at most so many blocks of 32 bytes (4 MB); a longer list makes more false
#: hits, which the exact join removes.
MAX_BLOCKS = 1 << 17
#: Up to so many listed keys the exact join broadcasts the list; beyond, it shuffles the hits.
BROADCAST_KEYS = 10_000

#: Verdict, host and path of the production rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def _bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the word masks (as longs) of its bits in the block."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(n_blocks))
    second = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(32 * WORDS - 1)) for i in range(BITS)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in places:
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 5) == w, F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), p.bitwiseAND(F.lit(31))).cast("long"))
        masks.append(mask)
    return block, masks


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """``block, w0..w7``: one row for each block that any ``key`` sets bits in."""
    block, masks = _bits(F.col("key"), n_blocks)
    rows = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)])


def _may_hit(probes: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` the filter can't rule out."""
    block, masks = _bits(F.col("key"), n_blocks)
    asked = probes.withColumn("block", block).withColumns({f"m{i}": m for i, m in enumerate(masks)})
    test = F.lit(True)
    for i in range(WORDS):
        test = test & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    # the filter has MAX_BLOCKS rows at most, whatever the lists' size
    return asked.join(F.broadcast(bloom), "block").where(test).select(probes.columns)


def judge_urls(urls: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Verdicts of the rows of ``urls`` by the longest listed entry that fits.

    ``listed`` has ``verdict``, ``host`` and ``path``: an entry fits a url on its host or a
    subdomain whose path starts with the entry's.  Each url asks the filter for its host
    suffixes (of the numbers of labels that are listed) with its path's prefixes (of the lengths
    that are listed), and what may hit goes to an exact join; so a host or path of any length
    asks for no more than the lists' own lengths.  Returns ``_row`` (a struct of the row's columns, whatever their names),
    ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``allow`` if none fits).
    Of entries of equal length the one with the longer path, then ``block``, wins; listed
    nulls and repeated entries are ignored.  Urls that are null or have no ``://`` have an
    empty host and path, and fit nothing.  Repeated rows are judged alike, each for itself;
    an empty table gives an empty result.
    """
    entries = listed.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    entries = entries.groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    entries = entries.withColumn("key", F.concat("r_host", "r_path"))
    lengths = F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")
    facts = entries.agg(F.count("*").alias("n"), lengths, F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels")).first()
    host, path = split_url(F.col(f"`{url}`"))
    rows = urls.select(F.struct("*").alias("_row"), host.alias("host"), path.alias("path"))
    if not facts["n"]:
        return rows.select("_row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    n_blocks = min(MAX_BLOCKS, 1 << max(4, math.ceil(math.log2(facts["n"] * 12 / (32 * WORDS) + 1))))
    bloom = bloom_filter(entries, n_blocks)
    # distinct places are judged once: a host and path may stand in very many rows; few bytes of
    # them are much work, so they are dealt out anew
    spread = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = rows.select("host", "path").where("host != ''").distinct().repartition(spread, "host", "path")
    labels = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(labels >= k, F.substring_index("host", ".", -k)) for k in facts["labels"]]))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in facts["lengths"]]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = places.select("host", "path", F.explode(suffixes).alias("p_host"), prefixes.alias("p_paths"))
    probes = probes.select("host", "path", "p_host", F.explode("p_paths").alias("p_path")).withColumn("key", F.concat("p_host", "p_path"))
    hits = _may_hit(probes, bloom, n_blocks)
    exact = F.broadcast(entries) if facts["n"] <= BROADCAST_KEYS else entries
    found = hits.join(exact, (hits["key"] == exact["key"]) & (F.col("p_host") == F.col("r_host")) & (F.col("p_path") == F.col("r_path")))
    best = F.max(F.struct(F.length("p_path") + F.length("p_host"), F.length("p_path"), F.col("r_verdict"), F.concat("p_host", "p_path").alias("rule"))).alias("best")
    found = found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", F.col("best.r_verdict").alias("found"))
    # urls without a host fit nothing and would all meet in one task
    out = rows.where("host != ''").join(found, ["host", "path"], "left")
    out = out.unionByName(rows.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "found": F.lit(None).cast("string")}))
    return out.select("_row", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame(RULES, "verdict string, host string, path string")
    out = judge_urls(pages, listed)
    return out.select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), places AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, r_host, r_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, host, path, verdict, r_host || r_path AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS place
  FROM places LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

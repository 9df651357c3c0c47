"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table with a row for each block of 256 bits in four BIGINT words. A canonical URL's hash names its
block, a second hash sets two bits in each word, and one join on the block number tests all eight bits. Rows that pass
go on to an exact hash join with the list, which removes false positives. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BITS_PER_KEY, MAX_RULES = 4, 20, 256


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """A page's canonical URL: host without www. or m. before it, path without slashes at its end; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, and its verdict; null without one. Of equally long ones, block wins, then the lesser."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name = verdict = F
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = name.when(fits, h + p), verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _marks(blocks: int, block: str, mask: str, key: str = "url_key") -> list[Column]:
    """Block number and bit masks (mask0..mask3) of a column of canonical URLs, named as said."""
    h = F.xxhash64(F.lit(1), key)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    masks = [bit(12 * i).bitwiseOR(bit(12 * i + 6)).alias(f"{mask}{i}") for i in range(WORDS)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias(block), *masks]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Filter table (block, word0..word3) of listed (url_key)."""
    words = (F.bit_or(f"mask{i}").alias(f"word{i}") for i in range(WORDS))
    return listed.select(*_marks(blocks, "block", "mask")).groupBy("block").agg(*words)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, listed (BOOLEAN) and possible (BOOLEAN: passed the filter).

    rules are (allow or block, host, path), at most MAX_RULES. listed has canonical URLs in url_key; nulls and repeats
    are ignored. Without a rule, a listed page is blocked and any other allowed. Null urls and urls without :// have an
    empty host and path. An empty list blocks nothing. Columns of pages with the new names are replaced, others may have
    any names. pages is scanned once: only keys that pass the filter are looked up, and in a shuffled join the others
    are spread over all tasks.
    """
    new = ("host", "path", "rule", "verdict", "listed", "possible")
    keep = [quoted(c) for c in pages.columns if c.lower() not in new]
    host, path = host_path(F.col(url_col))
    keys = materialize(listed.where("url_key is not null").select("url_key").distinct())
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS)))
    mine = free_name(pages, "_judged")  # all that is worked on sits in one column, so no name of pages can clash
    at = lambda *path: ".".join([mine, *path])
    rows = pages.select(*keep, F.struct(host.alias("host"), path.alias("path")).alias(mine))
    name, verdict = rule_for(F.col(at("host")), F.col(at("path")), rules)
    facts = [F.col(at("host")).alias("host"), F.col(at("path")).alias("path"), name.alias("rule"), verdict.alias("ruled")]
    rows = rows.select(*keep, F.struct(*facts, canonical(F.col(at("host")), F.col(at("path"))).alias("url_key")).alias(mine))
    rows = rows.select(*keep, F.struct(f"{mine}.*", *_marks(blocks, "block", "mask", at("url_key"))).alias(mine))
    words = small_side(materialize(bloom(keys, blocks))).select(F.struct("*").alias(free_name(pages, "_filter")))
    word = lambda n: F.col(f"{words.columns[0]}.{n}")
    rows = rows.join(words, F.col(at("block")) == word("block"), "left")
    passed = F.lit(True)
    for i in range(WORDS):
        passed &= word(f"word{i}").bitwiseAND(F.col(at(f"mask{i}"))) == F.col(at(f"mask{i}"))
    rows = rows.select(*keep, mine, F.coalesce(passed, F.lit(False)).alias(free_name(pages, "_possible")))
    possible = F.col(rows.columns[-1])
    exact = small_side(keys, "url_key").select(F.col("url_key").alias(free_name(pages, "_listed")))
    sought = F.when(possible, F.col(at("url_key"))).otherwise(F.concat(F.lit("\0"), F.col(at("url_key"))))
    both = rows.join(exact, sought == F.col(exact.columns[0]), "left")
    found = F.col(exact.columns[0]).isNotNull()
    verdict = F.coalesce(F.col(at("ruled")), F.when(found, "block").otherwise("allow"))
    return both.select(*keep, at("host"), at("path"), at("rule"), verdict.alias("verdict"), found.alias("listed"), possible.alias("possible"))


def url_list(spark: SparkSession, hosts: tuple[str, ...], sections: tuple[str, ...], numbers: int) -> DataFrame:
    """A list (url_key) made by a rule: in each section of each host, pages of even number below `numbers`, every other one with .html."""
    rows = spark.range(0, numbers, 2).withColumn("host", F.explode(F.array(*map(F.lit, hosts)))).withColumn("section", F.explode(F.array(*map(F.lit, sections))))
    return rows.select(F.concat("host", F.lit("/"), "section", F.lit("/"), F.col("id").cast("string"), F.when(F.col("id") % 4 == 2, ".html").otherwise("")).alias("url_key"))

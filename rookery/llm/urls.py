"""URL filter: a blocked Bloom filter in front of an exact hash join, all in DataFrame operations.

Each listed entry (host, path) has the key ``host + path``.  A url can only fit an
entry whose host is one of the url's host suffixes and whose path is as long as
some listed path, so its candidate keys are few.  The filter is split into blocks
of eight 64-bit words; a key has one block and one bit in each word, so one row
lookup decides.  Keys that the filter lets pass go to an exact join with the list,
which removes false positives; the longest entry that fits decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import SHARE, staged

#: Words of 64 bits in a block.
WORDS = 8
#: Listed keys for each block; 512 bits over 24 keys give about 1 false positive in 1000.
KEYS_PER_BLOCK = 24
#: Most blocks, so that the filter, of 64 bytes a block, can be sent to every executor whatever the list; beyond, blocks are fuller.
MOST_BLOCKS = 1 << 18
#: The list is sent to every executor up to this many rows, else joined by a shuffle with what the filter lets pass.
BROADCAST_ROWS = 100_000

#: Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Both empty for null and for a url without ``://``.
    """
    start = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def bits(key: Column) -> list[Column]:
    """The bit of a key in each word of its block."""
    h = F.xxhash64(key, F.lit("bit"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row (block, w0 .. w7) for each block that has keys; ``keys`` has a column ``key``."""
    marked = keys.select(block_of(F.col("key"), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def entry_key(host: Column, path: Column) -> Column:
    """The key of an entry; the host's length keeps the two parts apart."""
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def listed_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table (host, path, verdict)."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, verdict)")


def judge_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Verdict on every url: that of the longest listed entry that fits, else ``otherwise``.

    ``listed`` has host, path and verdict; an entry fits its host and all
    subdomains if the url's path starts with the entry's.  Of equal entries the
    smallest verdict counts; of equally long ones that with the longer host.
    Null urls and urls without ``://`` have an empty host and path, and fit
    nothing (but an entry of an empty host and path).  Hosts may have any number
    of labels: only as many as a listed host has are looked at.  Repeated rows
    stay, each with its verdict.  With an empty list all get ``otherwise``.
    """
    spark = pages.sparkSession
    entries = listed.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    entries = entries.select(entry_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"), "verdict")
    n, lengths, labels = entries.agg(F.count("*"), F.collect_set("path_length"), F.max("labels")).head()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not n:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    blocks = min(-(-n // KEYS_PER_BLOCK), MOST_BLOCKS)
    small = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)

    parts = F.split("host", r"\.")
    last = F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), F.lit(labels))  # no listed host has more labels
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda k: F.array_join(F.slice(last, k, F.lit(labels)), "."))
    prefix_lengths = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]), lambda k: k <= F.length("path"))
    candidates = F.flatten(F.transform(suffixes, lambda h: F.transform(prefix_lengths, lambda k: entry_key(h, F.substring("path", F.lit(1), k)))))
    # rows of one host and path have the same candidates: they are looked up once
    once = staged(rows.groupBy("host", "path").agg(F.count("*").alias("rows_")), "urls")
    keys = once.select("host", "path", F.explode(candidates).alias("key"))
    possible = keys.withColumn("block", block_of(F.col("key"), blocks)).join(F.broadcast(bloom_filter(entries, blocks)), "block")
    in_all = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(b) != 0 for k, b in enumerate(bits(F.col("key")))])
    exact = possible.where(in_all).select("host", "path", "key").join(small(entries), "key")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length", "rule")).alias("best"))
    best = staged(best, "urls-listed")
    # fewer than ``SHARE`` hosts and paths can be heavy, such as the empty ones of malformed urls; their rows stay where they are
    total = once.agg(F.coalesce(F.sum("rows_"), F.lit(0))).head()[0]
    heavy = once.where(F.col("rows_") * SHARE > total).join(best, ["host", "path"], "left").select("host", "path", F.lit(True).alias("heavy_"), F.col("best").alias("heavy_best"))
    marked = rows.join(F.broadcast(heavy), ["host", "path"], "left")
    there = marked.where("heavy_").select("id", "host", "path", F.col("heavy_best").alias("best"))
    other = marked.where("heavy_ is null").select("id", "host", "path").join(best, ["host", "path"], "left")
    return there.unionByName(other).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


ORACLE_SQL = r"""
with r(host, path, verdict) as (values ('org','/','allow'),('example.org','/es/','block'),('example.org','/en/1','block'),('com','/fr/','allow'),('com','/de/','block')),
p as (select page_id, case when url is null or strpos(url,'://')=0 then '' else substr(url, strpos(url,'://')+3) end rest from pages),
u as (select page_id, translate(regexp_extract(rest,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) path from p),
m as (select u.page_id, u.host, u.path, r.host||r.path as rule, r.verdict, row_number() over (partition by u.page_id order by length(r.host||r.path) desc nulls last, length(r.host) desc) k
 from u left join r on (u.host=r.host or suffix(u.host,'.'||r.host)) and starts_with(u.path,r.path))
select page_id, host, path, rule, coalesce(verdict,'allow') verdict from m where k=1
"""

"""Sharding by jump consistent hashing, in DataFrame operations.

A row's shard depends on its key and the number of shards alone; there is no ring
table, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.llm.common import staged

#: The step of jump hash's generator is key * MULTIPLIER + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757
#: Parts of a shard that are numbered apart.
BUCKETS = 256
#: Copies of one row that one task writes out.
COPIES = 65_536
#: The order of rows in a part.
ORDER = ("key", "id", "size", "text_crc32")

_LOW = 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator on two 32-bit halves; no product exceeds 63 bits."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    m1, m0 = m_low >> 16, m_low & 0xFFFF
    n1, n0 = m_high >> 16, m_high & 0xFFFF
    bits = lambda c, mask: c.bitwiseAND(F.lit(mask).cast("long"))
    times16 = lambda c, k: c * F.lit(k).cast("long")
    modulo = lambda c, hi, lo: times16(bits(times16(c, hi), 0xFFFF), 1 << 16) + times16(c, lo)
    upper = times16(low, m1)
    sum_low = times16(low, m0) + times16(bits(upper, 0xFFFF), 1 << 16) + F.lit(1).cast("long")
    carry = F.shiftright(sum_low, 32) + F.shiftright(upper, 16)
    new_high = carry + modulo(high, m1, m0) + modulo(low, n1, n0)
    return bits(new_high, _LOW), bits(sum_low, _LOW)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int) of a 64-bit key; null keys count as 0.

    The bucket grows with every jump, so ``shards`` jumps always suffice.  Half
    of all keys are done after a few, so a short loop comes first and the full
    one is run only for keys that need it.
    """
    key = F.coalesce(key, F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(F.lit(_LOW).cast("long")).alias("l"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _step(s["h"], s["l"])
        above = F.shiftright(high, 1) + F.lit(1).cast("long")  # the generator's upper 31 bits, and 1
        after = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / above.cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(high.alias("h"), low.alias("l"), s["j"].alias("b"), after.alias("j"))).otherwise(s)

    loop = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, jump)
    short = min(shards, 12)
    first = loop(short)
    return F.when(first["j"] >= shards, first["b"]).otherwise(loop(shards)["b"]).cast("int") if short < shards else first["b"].cast("int")


def long_key(df: DataFrame, col: str) -> Column:
    """A column as a 64-bit key: whole numbers as they are, anything else hashed."""
    whole = df.schema[col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(col).cast("long") if whole else F.xxhash64(col)


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row of ``docs`` by the law ``key``.

    ``size`` is the text's UTF-8 bytes plus 16, ``text_crc32`` its checksum (null
    for a null text), ``slot`` the row's place in its shard, gapless from 0, and
    ``grown_shard`` its shard among one more.  Rows with one key share a shard.
    Equal rows get slots of their own, next to one another.

    Slots need no sort of a whole shard: equal rows are counted before anything
    is ordered (so copies of one row never meet in one task), each shard is cut
    into ``BUCKETS`` parts, and a part's offset comes from the parts' totals.
    """
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), long_key(docs, id_col).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    counted = rows.groupBy("id", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    # written once: it is used twice below, and has no texts
    placed = staged(counted.withColumns({"shard": jump_hash(F.col("key"), shards), "grown_shard": jump_hash(F.col("key"), shards + 1), "bucket": bucket(F.col("key"), F.col("text_crc32"))}), "shards")
    inside = Window.partitionBy("shard", "bucket").orderBy(*ORDER)
    part = Window.partitionBy("shard").orderBy("bucket")
    total = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("all")).withColumn("offset", F.sum("all").over(part) - F.col("all")).drop("all")
    ended = placed.withColumn("through", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # at most shards * BUCKETS rows, whatever the input
    slots = ended.join(F.broadcast(total), ["shard", "bucket"]).withColumn("last", F.col("offset") + F.col("through"))
    slots = slots.select("id", "size", "text_crc32", "shard", "grown_shard", (F.col("last") - F.col("n")).alias("from"), (F.col("last") - 1).alias("to"))
    # a row with very many copies is dealt over tasks before they are written out
    pieces = slots.where(F.col("to") - F.col("from") >= COPIES).withColumn("at", F.explode(F.sequence("from", "to", F.lit(COPIES).cast("long"))))
    pieces = pieces.withColumns({"from": F.col("at"), "to": F.least("to", F.col("at") + COPIES - 1)}).drop("at").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = slots.where(F.col("to") - F.col("from") < COPIES).unionByName(pieces)
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("from", "to")).alias("slot"), "grown_shard",
    )


def bucket(key: Column, crc: Column) -> Column:
    some = lambda c: F.pmod(F.coalesce(c, F.lit(0).cast("long")), F.lit(BUCKETS))
    return F.pmod(some(key) + some(crc), F.lit(BUCKETS))


#: The query ``shard(documents, 40)`` in SQL; DuckDB has no crc32, so it is spelt out.
ORACLE_SQL = """
with steps as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t),
d as (select doc_id, cast(coalesce(octet_length(encode(text)), 0) + 16 as bigint) size, hex(encode(text)) h, octet_length(encode(text)) n from documents),
c as (select doc_id, size, case when n is not null then xor(list_reduce(range(0, n), lambda c, i: xor(t[cast(xor(c & 255, cast('0x' || substr(h, cast(2 * i + 1 as integer), 2) as bigint)) as integer) + 1], c >> 8), 4294967295), 4294967295) end text_crc32 from d, steps),
k as (select *, cast(coalesce(doc_id, 0) as hugeint) + case when doc_id < 0 then 18446744073709551616 else 0 end u from c),
j as (select *, list_transform([40, 41], lambda n: list_reduce(range(0, n), lambda s, x: case when s.j < n then
  {'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616, 'b': s.j,
   'j': cast(floor((s.j + 1) * (2147483648.0::double / cast(((s.k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 as double))) as bigint)} else s end,
  {'k': cast(u as uhugeint), 'b': -1::bigint, 'j': 0::bigint}).b) s from k)
select doc_id, size, text_crc32, 'key' law, cast(s[1] as integer) shard,
 row_number() over (partition by s[1] order by ((coalesce(doc_id, 0) % 256 + 256) % 256 + coalesce(text_crc32, 0) % 256) % 256, doc_id nulls first, size, text_crc32 nulls first) - 1 slot,
 cast(s[2] as integer) grown_shard from j
"""

"""Proportional stratified interleaving into shards of equal row counts.

Rows of each source are put in a seeded random order; a row's fractional rank is its
place there over the size of its source. Sorted by fractional rank, every stretch of
the whole table holds each source in its share, so shards cut from it match the mixture.

Both rankings are made of parts of bounded size: a part's first rank is a running sum
over part counts, and row_number runs only within a part, so neither a large source nor
the global order meets in one task. Running sums go by blocks of parts, then over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_or_empty

SHARDS = 40
SEED = 20_241
#: Rows in one part of a ranking, on average.
PART_ROWS = 4_000
#: Parts in one block of a running sum.
BLOCK_PARTS = 4_096
ROW_BYTES = 16


def rows_to_place(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, stratum): all that the ranking needs, no text."""
    text = text_or_empty(F.col("text").cast("string"))
    crc = F.crc32(F.encode(text, "UTF-8"))
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        # a null source is a stratum of its own
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("stratum"),
    )


def shuffled(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Stored ``rows`` with draw: a seeded hash of id and text. Only rows that are equal
    in both take their row number in, so that very many of them do not share one draw;
    they are the same for the result, whatever their order."""
    twice = cut(
        rows.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"))
    )
    base = F.xxhash64(F.lit(seed), "doc_id", "text_crc32")
    if twice.isEmpty():
        return rows.withColumn("draw", base)
    same = rows["doc_id"].eqNullSafe(twice["_id"]) & (rows["text_crc32"] == twice["_crc"])
    again = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "row")
    return rows.join(twice, same, "left").withColumn("draw", F.when(F.col("_crc").isNull(), base).otherwise(again)).drop("_id", "_crc")


def _firsts(counts: DataFrame, *by: str) -> DataFrame:
    """(*by, part, n) -> (*by, part, first): rows before each part, in the order of parts."""
    blocks = counts.withColumn("block", F.expr(f"part div {BLOCK_PARTS}"))
    # one row for BLOCK_PARTS * PART_ROWS rows
    whole = blocks.groupBy(*by, "block").agg(F.sum("n").alias("rows"))
    before = whole.select(*by, "block", (F.sum("rows").over(Window.partitionBy(*by).orderBy("block")) - F.col("rows")).alias("before"))
    within = Window.partitionBy(*by, "block").orderBy("part")
    placed = blocks.withColumn("inner", F.sum("n").over(within) - F.col("n"))
    return placed.join(before, [*by, "block"]).select(*by, "part", (F.col("before") + F.col("inner")).alias("first"))


def interleave(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with place: 0 to n - 1 in the interleaved order."""
    # 1. rank within the stratum: ordered by (part, draw), a random order as well; a
    # stratum has as many parts as its size asks for
    totals = cut(rows.groupBy("stratum").agg(F.count("*").alias("total")))
    drawn = rows.join(totals, "stratum").withColumn("part", F.pmod("draw", F.ceil(F.col("total") / PART_ROWS)))
    # else the join's placement by stratum would do for the windows, too
    drawn = drawn.repartition("stratum", "part")
    firsts = _firsts(drawn.groupBy("stratum", "part").agg(F.count("*").alias("n")), "stratum")
    # sources begin at different fractions, so that small ones do not meet in the middle
    begin = F.pmod(F.xxhash64("stratum", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    in_part = Window.partitionBy("stratum", "part").orderBy("draw", "doc_id", "text_crc32", "size")
    ranked = (
        drawn.withColumn("k", F.row_number().over(in_part))
        .join(firsts, ["stratum", "part"])
        .withColumn("fraction", (F.col("first") + F.col("k") - 1 + begin) / F.col("total"))
    )
    ranked = stored(ranked.select("doc_id", "size", "text_crc32", "stratum", "fraction"), "shard-ranks")
    parts = max(1, -(-n // PART_ROWS))
    # 2. place by fractional rank: each stretch of fractions holds its share of all rows
    pieces = ranked.withColumn("part", F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)))
    before = _firsts(pieces.groupBy("part").agg(F.count("*").alias("n")))
    in_stretch = Window.partitionBy("part").orderBy("fraction", "stratum")
    return (
        pieces.withColumn("k", F.row_number().over(in_stretch))
        .join(before, "part")
        .withColumn("place", F.col("first") + F.col("k") - 1)
        .drop("part", "first", "k")
    )


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    The law is `rows`: counts of any two shards are at most one apart, and so are, but
    for rounding, the counts of each source. Null texts count no bytes; null sources
    are one source; repeated rows are placed one by one. Ties in the fractional rank go
    by the source's name. With fewer rows than shards the rows get different shards. A
    text of any length is read once for its size; other columns are ignored. An empty
    table gives an empty result.
    """
    rows = stored(rows_to_place(docs).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    placed = interleave(shuffled(rows, seed), max(n, 1))
    number = F.expr(f"place * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {max(n, 1)} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", number)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("place") - first).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""Uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix.

Rows lie in blocks (equal ranges of a hash of the row). How many rows each block sends to each shard is drawn
exactly: a binary tree over the blocks splits the shards' free places between its two halves by multivariate
hypergeometric draws, until each leaf holds one block's row of the matrix. Each block permutes its rows and deals
them by its row of the matrix; each shard permutes what arrives. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from axisframe.llm.common import free_name, ordinals, uniform, written

#: The part of a draw's distribution beyond this many standard deviations is under the spacing of doubles.
_TAIL_SD = 9


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(places: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` places are marked, if ``marked`` of all ``places`` are: the inverse CDF at u."""

    def bounds(q: Column) -> Column:
        n, k, m = q["n"].cast("double"), q["k"].cast("double"), q["m"].cast("double")
        low = F.greatest(F.lit(0).cast("long"), q["m"] + q["k"] - q["n"])
        high = F.least(q["k"], q["m"])
        mode = F.greatest(low, F.least(high, F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")))
        spread = F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * (1 - k / n) * (n - m) / F.greatest(F.lit(1.0), n - 1)))
        reach = (F.ceil(spread * _TAIL_SD) + 12).cast("long")
        return F.struct(q["n"].alias("n"), q["k"].alias("k"), q["m"].alias("m"), q["u"].alias("u"), F.greatest(low, mode - reach).alias("low"), mode.alias("mode"), F.least(high, mode + reach).alias("high"))

    def up(b: Column, x: Column) -> Column:
        """P(x + 1) / P(x)."""
        return (b["k"] - x).cast("double") * (b["m"] - x) / ((x + 1).cast("double") * (b["n"] - b["k"] - b["m"] + x + 1))

    def walk(b: Column) -> Column:
        none = F.array().cast("array<bigint>")
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))

        def step(ratio):
            return lambda a, x: _let(a["p"] * ratio(x), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s")))

        below = F.aggregate(F.when(b["mode"] > b["low"], F.sequence(b["mode"] - 1, b["low"], F.lit(-1).cast("long"))).otherwise(none), start, step(lambda x: 1 / up(b, x)))
        above = F.aggregate(F.when(b["mode"] < b["high"], F.sequence(b["mode"], b["high"] - 1)).otherwise(none), start, step(lambda x: up(b, x)))
        total = F.struct(below["p"].alias("p"), ((1 + below["s"] + above["s"]) * b["u"]).alias("goal"))

        def find(t: Column) -> Column:
            first = F.struct(t["p"].alias("p"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("x"))

            def move(a: Column, x: Column) -> Column:
                c = a["c"] + a["p"]
                return F.struct((a["p"] * up(b, x)).alias("p"), c.alias("c"), F.when((a["x"] < 0) & (c >= t["goal"]), x).otherwise(a["x"]).alias("x"))

            return F.aggregate(F.sequence(b["low"], b["high"]), first, move, lambda a: F.when(a["x"] < 0, b["high"]).otherwise(a["x"]))

        return _let(total, find)

    return _let(F.struct(places.alias("n"), marked.alias("k"), drawn.alias("m"), u.alias("u")), lambda q: F.when(q["n"] > 0, _let(bounds(q), walk)).otherwise(F.lit(0).cast("long")))


def _split(level: int, node: Column, free: Column, drawn: Column, seed: int) -> Column:
    """The left half's share of each shard's free places, ``drawn`` places in all."""
    start = F.struct(F.aggregate(free, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), drawn.alias("m"), F.array().cast("array<bigint>").alias("x"))

    def move(a: Column, k: Column) -> Column:
        u = uniform(F.lit(seed), F.lit(level), node, F.size(a["x"]))
        return _let(hypergeometric(a["n"], k, a["m"], u), lambda x: F.struct((a["n"] - k).alias("n"), (a["m"] - x).alias("m"), F.concat(a["x"], F.array(x)).alias("x")))

    return F.aggregate(free, start, move, lambda a: a["x"])


def communication_matrix(block_rows: DataFrame, bits: int, shards: int, rows: int, seed: int) -> DataFrame:
    """From (block, n_rows) of 2^bits blocks: (block, counts), where counts[s] rows go to shard s.

    Row sums are the blocks' sizes, column sums the shards'; the first ``rows mod shards`` shards get one more.
    """
    spark = block_rows.sparkSession
    free = F.array(*[F.lit(rows // shards + (s < rows % shards)).cast("long") for s in range(shards)])
    all_blocks = spark.range(1 << bits).withColumnRenamed("id", "b").join(block_rows, F.col("b") == F.col("block"), "left")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"])
    tree = all_blocks.agg(sizes.alias("sizes")).select(F.lit(0).cast("long").alias("node"), "sizes", free.alias("free"))
    for level in range(bits):
        if level == 8:
            tree = tree.repartition(F.col("node"))
        half = 1 << (bits - level - 1)
        left = F.slice(F.col("sizes"), 1, half)
        drawn = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        halves = _let(
            _split(level, F.col("node"), F.col("free"), drawn, seed),
            lambda x: F.array(
                F.struct((F.col("node") * 2).alias("node"), left.alias("sizes"), x.alias("free")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.slice(F.col("sizes"), half + 1, half).alias("sizes"), F.zip_with(F.col("free"), x, lambda a, b: a - b).alias("free")),
            ),
        )
        tree = tree.select(F.inline(halves))
    return tree.select(F.col("node").alias("block"), F.col("free").alias("counts"))


def shuffle_into_shards(docs: DataFrame, shards: int = 40, *, seed: int = 20240601, rows_per_block: int = 16384) -> DataFrame:
    """Append ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard): a uniform random arrangement.

    Law ``rows``: shard sizes differ by one row at most, whatever the texts. Equal texts are not kept together.
    Every row is dealt once: null ids or texts, empty and long texts, and repeated rows are rows like any other
    (rows equal in every column are interchangeable and start in one block). An empty table gives no rows. Input
    columns named ``shard`` or ``slot`` are replaced; helper columns never clash with the input's.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = docs.drop("shard", "slot")
    block, first, second, place, counts, sender = (free_name(docs, stem=s) for s in ("block", "first_key", "second_key", "place", "counts", "sender"))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.count()
    bits = (rows // rows_per_block).bit_length()
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *hashed), 64 - bits) if bits else F.lit(0).cast("long")
    dealt = docs.withColumns({block: number, first: F.xxhash64(F.lit(seed + 1), *hashed), second: F.xxhash64(F.lit(seed + 2), *hashed)})
    sizes = dealt.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n_rows"))
    matrix = written(communication_matrix(sizes, bits, shards, rows, seed), "matrix")
    ends = F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    matrix = matrix.select(F.col("block").alias(sender), ends.alias(counts))
    local = Window.partitionBy(block).orderBy(first, second)
    placed = dealt.withColumn(place, F.row_number().over(local) - 1).join(matrix, F.col(block) == F.col(sender))
    sent = placed.withColumn("shard", F.size(F.filter(counts, lambda end: end <= F.col(place))).cast("int"))
    sent = sent.select(*docs.columns, first, second, "shard")
    return ordinals(sent, ["shard"], second, [F.col(first)], rows_per_block, "slot", total=rows).select(*docs.columns, "shard", "slot")


def digest(sharded: DataFrame) -> DataFrame:
    """The reported columns; a null text counts as no bytes."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

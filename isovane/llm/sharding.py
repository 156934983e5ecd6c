"""Shards along a Hilbert curve, in DataFrame functions alone.

Metadata dimensions are quantised to ``BITS`` bits each, a row's cell has a place on the Hilbert curve through
all cells, rows are sorted by that place, and the sorted rows are cut into runs of equal count. Rows near
each other in all dimensions share shards, so that min and max statistics of files prune on any dimension.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered

SHARDS = 24
BITS = 8
LAW = "rows"
DIMENSIONS = ("source", "lang", "size")


@cache
def curve_table(dims: int) -> list[tuple[int, int]]:
    """(digit, next state) for each state and each corner of a cell's 2^dims parts, as state * 2^dims + corner.

    A state is the corner where the curve enters a cell and the axis along which it leaves. Corners are visited in
    Gray code order, turned into the state's frame; each visited part gets its own entry and axis.
    """
    n, corners = dims, 1 << dims
    full = corners - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full if k % n else x
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(corners)}
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  number of trailing ones
    enters = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    axis = lambda i: 0 if i == 0 else trailing(i - 1) % n if i % 2 == 0 else trailing(i) % n
    table = []
    for state in range(corners * n):
        entry, along = state // n, state % n
        for corner in range(corners):
            turned = left(corner ^ entry, n - (along + 1) % n)
            digit = rank[turned]
            entered = entry ^ left(enters(digit), along + 1)
            table.append((digit, entered * n + (along + axis(digit) + 1) % n))
    return table


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the curve, from 0 to 2^(bits * dimensions) - 1, for cell coordinates below 2^bits."""
    n = len(cells)
    if not 2 <= n <= 5 or n * bits > 62:
        raise ValueError("two to five dimensions and at most 62 bits together")
    table = curve_table(n)
    digit = F.array(*[F.lit(d) for d, _ in table])
    then = F.array(*[F.lit(s) for _, s in table])

    def level(acc: Column, b: Column) -> Column:
        corner = F.lit(0)
        for j, cell in enumerate(cells):
            corner = corner + F.getbit(cell.cast("long"), b).cast("int") * F.lit(1 << j)
        at = acc.state * (1 << n) + corner
        return F.struct((acc.place * (1 << n) + F.get(digit, at)).alias("place"), F.get(then, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, level, lambda acc: acc.place)


def size_cell(size: Column) -> Column:
    """0 to 255 for a size: its number of bits, then the two bits after the first; whole numbers only."""
    digits = F.bin(size)
    after = F.conv(F.substring(F.concat(digits, F.lit("00")), 2, 2), 2, 10).cast("int")
    return F.least(F.length(digits) * 4 + after, F.lit(255)).cast("int")


def rank_cells(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """(value, cell): the distinct values of a column in order, null last, spread evenly over the cells."""
    values = numbered(rows.select(F.col(name).alias("value")).distinct(), [F.col("value").isNull(), "value"], "place")
    return values.select("value", F.floor(F.col("place") * (1 << bits) / F.lit(max(1, values.count()))).cast("int").alias("cell"))


def shard(docs: DataFrame, carry: list[str], dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carry, shard, slot) for every row of ``docs``: run ``shard`` of the curve and the place in it, from 0.

    Runs differ by one row at most, the longer ones first; with fewer rows than shards the last ones stay empty.
    ``dimensions`` are columns: ``size`` and other whole numbers are quantised by their leading bits (negative
    and null ones: 0), strings by their rank among all values (null last). Rows of one cell are in order of ``tie`` (null first); rows
    that agree in all of these are alike for the order, and share its places in any way. ``carry`` must not
    hold names that begin with "_".
    """
    kinds = dict(docs.dtypes)
    cells, rows = [], docs
    for i, name in enumerate(dimensions):
        if kinds[name] == "string":
            table = cut(rank_cells(docs.select(name), name).select(F.col("value").alias(f"_v{i}"), F.col("cell").alias(f"_c{i}")))
            few = F.broadcast(table) if table.count() <= 20_000 else table
            rows = rows.join(few, F.col(name).eqNullSafe(F.col(f"_v{i}")))
        else:
            rows = rows.withColumn(f"_c{i}", size_cell(F.greatest(F.coalesce(F.col(name).cast("long"), F.lit(0)), F.lit(0))))
        cells.append(F.col(f"_c{i}"))
    keyed = rows.withColumn("_place", hilbert_index(cells)).select(*carry, "_place", *[F.col(t).alias(f"_t{j}") for j, t in enumerate(tie)])
    ranked = numbered(keyed, ["_place", *[f"_t{j}" for j in range(len(tie))]], "rank")
    total = docs.count()
    base, more = divmod(total, shards)
    head = more * (base + 1)
    index = F.when(F.col("rank") < head, F.expr(f"rank div {base + 1}")).otherwise(F.expr(f"{more} + (rank - {head}) div {max(base, 1)}"))
    start = F.when(F.col("rank") < head, F.col("shard") * (base + 1)).otherwise(F.lit(head) + (F.col("shard") - more) * base)
    return ranked.withColumn("shard", index.cast("int")).withColumn("slot", (F.col("rank") - start).cast("long")).select(*carry, F.col("_place").alias("curve"), "shard", "slot")


def size_of(text: str) -> Column:
    """UTF-8 bytes of the whole text (null: none) plus 8."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(8)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """What sharding looks at: doc_id, source, lang, size, text_crc32."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size_of("text").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law ``rows``."""
    rows = shard(cut(sized(docs)), ["doc_id", "size", "text_crc32"], shards=shards, tie=("doc_id", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, folder: str = "shard") -> None:
    """All columns of ``docs`` as Parquet under ``path``/``folder``=N, each shard in the order of the curve.

    ``folder`` must not be a column of ``docs``.
    """
    if folder in docs.columns:
        raise ValueError(f"{folder} is a column of the table; name another folder")
    wide = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    facts = wide.select(F.col("row"), "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size_of("text").alias("size"))
    placed = shard(facts, ["row"], shards=shards).select("row.*", F.col("shard").alias(folder), F.col("slot").alias("_slot"))
    placed.repartitionByRange(shards, folder).sortWithinPartitions(folder, "_slot").drop("_slot").write.partitionBy(folder).parquet(path)

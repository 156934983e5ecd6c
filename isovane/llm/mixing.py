"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Sources share a budget of words by weight. A source's target stops at ``max_epochs`` times its size, and
what it can't take is shared among the others by weight until no target is above its cap. The rounds of
clamping and sharing end at one water level: target = min(cap, weight * level). Sources in order of
cap / weight are clamped one after another, so running sums over that order give the level at once.

A target is ``whole`` repetitions of every document and a fraction. For the fraction, documents are taken in
seeded order (md5) while their words fit, then some single ones of those left that fill the gap: the largest
that fits, ``FILLERS`` - 1 times, and then the one whose size comes nearest to what is left of the gap. Rows that share
doc_id and size share a place in that order, and are told apart by their place in the table: each is a unit of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
FILLERS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources with more rows than this is joined, not broadcast.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs without ASCII white space in the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_key(size: Column, seed: int = SEED) -> Column:
    """Seeded place of a document in its source, 32 hex digits; rows that share doc_id and size share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string")))


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights go round over the sources by code point, null last. Targets add up to ``share`` times all sizes,
    or to all caps if these are less. A source of size 0 gets 0. Each round clamps the sources below the level and shares
    what they leave; it takes three sums, so sources may be many.
    """
    turn = (F.col("turn") % len(weights) + 1).cast("int")
    placed = numbered(sources.select("source", "source_size"), [F.col("source").isNull(), "source"], "turn")
    weighed = cut(placed.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"), (F.col("source_size") * F.lit(max_epochs)).alias("cap")))
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, clamped = share * total / weight if weight else 0.0, 0
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        caps, free, n = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == clamped:
            break
        level, clamped = (share * total - caps) / free if free else float("inf"), n
    return weighed.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _digits(n: int) -> int:
    """Hex digits of a bucket, so that buckets and rows of a bucket are about as many."""
    d = 1
    while d < 6 and 256**d < n:
        d += 1
    return d


def _filled_once(rows: DataFrame, ends: DataFrame, nearest: bool) -> DataFrame:
    """``ends`` (e_source, upto, gap, extra) with one more unit taken where that brings a source nearer to its target."""
    left = F.col("gap") - F.col("size")
    free = ~_up_to("upto") & ~F.array_contains("extra", F.struct("key", "place")) & (F.col("size") > 0)
    useful = F.abs(left) < F.col("gap") if nearest else left >= 0
    beyond = rows.join(_few(ends), rows["source"].eqNullSafe(F.col("e_source")) & free & useful)
    best = beyond.groupBy("e_source").agg(F.min(F.struct(F.abs(left).alias("off"), "key", "place", left.alias("gap"))).alias("best"))
    best = best.select(F.col("e_source").alias("n_source"), F.struct("best.key", "best.place").alias("more"), F.col("best.gap").alias("rest"))
    joined = ends.join(best, F.col("e_source").eqNullSafe(F.col("n_source")), "left")
    extra = F.when(F.col("more").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("more")))
    return cut(joined.select("e_source", "upto", F.coalesce("rest", "gap").alias("gap"), extra.alias("extra")))


def _up_to(end: str) -> Column:
    """The unit (key, place) is at or before the unit ``end``."""
    return (F.col("key") < F.col(end)["key"]) | ((F.col("key") == F.col(end)["key"]) & (F.col("place") <= F.col(end)["place"]))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _crossed(table: DataFrame, group: str, order: str, amount: str, room: Column) -> DataFrame:
    """Of each group, the row at which the running sum of ``amount`` first exceeds ``room``; ``before`` is the sum before it."""
    ahead = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = table.withColumn("before", F.coalesce(F.sum(amount).over(ahead), F.lit(0)))
    return summed.where((F.col("before") <= room) & (F.col("before") + F.col(amount) > room))


def _ends(rows: DataFrame, filled: DataFrame, parts: DataFrame, prefix: Column) -> DataFrame:
    """(e_source, upto, gap): the last unit that fits into each source's quota, and the words still missing.

    Found in steps, over sums of key prefixes, of keys in one prefix, of table parts for one key, and of the rows of one part,
    so no task sees a source, nor all rows of a key.
    """
    quotas = filled.select(F.col("source").alias("q_source"), "quota")
    at_prefix = _crossed(parts.join(quotas, F.col("source").eqNullSafe(F.col("q_source"))), "source", "prefix", "words", F.col("quota"))
    edge = cut(at_prefix.select(F.col("source").alias("e_source"), F.col("prefix").alias("e_prefix"), (F.col("quota") - F.col("before")).alias("room")))
    at_edge = rows.join(_few(edge), rows["source"].eqNullSafe(F.col("e_source")) & (prefix == F.col("e_prefix")))
    by_key = at_edge.groupBy("e_source", "room", "key").agg(F.sum("size").alias("words"), F.max("size").alias("one"))
    at_key = _crossed(by_key, "e_source", "key", "words", F.col("room")).withColumn("rest", F.col("room") - F.col("before"))
    keys = cut(at_key.select("e_source", F.col("key").alias("e_key"), "one", "rest", F.floor(F.col("rest") / F.col("one")).alias("fit")))
    split = keys.where("fit > 0")
    in_key = rows.join(_few(split), rows["source"].eqNullSafe(F.col("e_source")) & (F.col("key") == F.col("e_key")))
    by_part = in_key.groupBy("e_source", "fit", F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    last_part = cut(_crossed(by_part, "e_source", "part", "n", F.col("fit") - 1).select(F.col("e_source").alias("l_source"), F.col("part").alias("l_part"), (F.col("fit") - F.col("before")).alias("nth")))
    here = in_key.join(_few(last_part), F.col("e_source").eqNullSafe(F.col("l_source")) & (F.shiftright("place", 33) == F.col("l_part")))
    nth = here.withColumn("n", F.row_number().over(Window.partitionBy("e_source").orderBy("place"))).where("n = nth").select(F.col("e_source").alias("n_source"), F.col("place").alias("n_place"))
    found = keys.join(nth, F.col("e_source").eqNullSafe(F.col("n_source")), "left")
    upto = F.struct(F.col("e_key").alias("key"), F.coalesce("n_place", F.lit(-1)).alias("place"))
    return found.select("e_source", upto.alias("upto"), (F.col("rest") - F.col("fit") * F.col("one")).alias("gap"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """A row for each source of (source, size, key, place): its target and which units it takes.

    ``p_whole``: repetitions of every document; one more for units up to ``p_upto`` and for those in ``p_extra``.
    """
    prefix = F.substring("key", 1, _digits(rows.count()))
    parts = cut(rows.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words")))
    filled = water_fill(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    filled = cut(filled.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")))
    ends = cut(_ends(rows, filled, parts, prefix)).withColumn("extra", F.array().cast("array<struct<key:string,place:bigint>>"))
    for n in range(FILLERS):
        ends = _filled_once(rows, ends, nearest=n == FILLERS - 1)
    known = filled.join(ends, filled["source"].eqNullSafe(F.col("e_source")), "left")
    return cut(known.select(filled["source"].alias("p_source"), F.col("source_size").alias("p_size"), F.col("target").alias("p_target"), F.col("whole").alias("p_whole"), F.col("upto").alias("p_upto"), F.col("extra").alias("p_extra")))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, copies) for every row of ``docs``; ``row`` is a struct of all its columns.

    ``copies`` is how often the mix takes the document, 0 and at most ``max_epochs`` times rounded up. ``size``
    counts words unless given. Null sources are one source, null and empty texts have size 0. Repeated rows, and rows
    with a null doc_id, are taken one by one. ``docs`` is read twice and must give its rows in the same places each time, as
    tables do. Which of the rows that share doc_id and size are taken follows these places, all else the rows and the seed alone.
    """
    size = word_count(F.col("text")) if size is None else size
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), sample_key(size, seed).alias("key"), F.monotonically_increasing_id().alias("place"))
    sources = plan(cut(keyed.select("source", "size", "key", "place")), weights, share, max_epochs)
    joined = keyed.join(_few(sources), F.col("source").eqNullSafe(F.col("p_source")))
    one_more = F.coalesce(_up_to("p_upto"), F.lit(False)) | F.coalesce(F.array_contains("p_extra", F.struct("key", "place")), F.lit(False))
    most = -int(-max_epochs // 1)
    copies = F.least(F.col("p_whole") + one_more.cast("long"), F.lit(most).cast("long"))
    return joined.select("row", "size", F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), copies.alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return mix(sized, F.col("words")).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its copies."""
    taken = mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return taken.select("row.*")


_SQL_HEAD = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (
  SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR))
            || lpad(CAST(row_number() OVER (PARTITION BY source, doc_id, size) AS VARCHAR), 12, '0') AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS turn FROM k GROUP BY source),
w AS (SELECT source, source_size, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source),
                b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT arg_min(level, place) FROM l WHERE level <= cap / weight)) AS target FROM l),
q AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole,
         target - floor(target / greatest(source_size, 1)) * source_size AS quota FROM t),
r AS (
  SELECT k.doc_id, k.source, k.size, k.key, q.source_size, q.target, q.whole, q.quota,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS upto
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
g0 AS (SELECT source, any_value(quota) - coalesce(max(upto) FILTER (WHERE upto <= quota), 0) AS gap, [''] AS extra FROM r GROUP BY source)"""

_SQL_FILLER = r"""
x{n} AS (
  SELECT r.source, arg_min((r.key, g.gap - r.size), (abs(g.gap - r.size), r.key)) AS best
  FROM r JOIN g{m} g ON r.source IS NOT DISTINCT FROM g.source
  WHERE r.upto > r.quota AND r.size > 0 AND NOT list_contains(g.extra, r.key) AND {useful} GROUP BY r.source),
g{n} AS (
  SELECT g.source, coalesce(x.best[2], g.gap) AS gap, CASE WHEN x.best IS NULL THEN g.extra ELSE list_append(g.extra, x.best[1]) END AS extra
  FROM g{m} g LEFT JOIN x{n} x ON g.source IS NOT DISTINCT FROM x.source)"""

_SQL_TAIL = r"""
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * least(r.whole + CASE WHEN r.upto <= r.quota OR list_contains(g.extra, r.key) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM r JOIN g{n} g ON r.source IS NOT DISTINCT FROM g.source
"""

ORACLE = ",".join([_SQL_HEAD, *[_SQL_FILLER.format(n=i + 1, m=i, useful="abs(g.gap - r.size) < g.gap" if i == FILLERS - 1 else "g.gap >= r.size") for i in range(FILLERS)]]) + _SQL_TAIL.format(n=FILLERS)

"""Filter interaction audit: what every order of the filters keeps and removes, from one CUBE over their failure flags.

Documents become rows of failure flags, these one row for each part and combination of flags. ``CUBE(part, A, .. E)`` over
that small table holds, for every subset S of the filters, a row whose selected flags are all false: the documents
that survive S. A step of an order goes from a subset to one with one filter more, so joining pairs of subsets gives
all steps of all orders, and the Shapley sums too, without another look at the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.plans.lineage import cut

FILTERS = ("A", "B", "C", "D", "E")
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_UPPER_PERCENT = 10
MARKS = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(65, 91))
#: Documents without an id would all meet in one task of the join with the labels; they are dealt over so many keys.
SPREAD = 1024


def text_failures(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a whole text fails A (few words), B (repeated words), C (capitals), D (marks).

    Words are what blanks of ASCII separate: ``bytes.split`` without an argument cuts at exactly \\x20 and \\x09-\\x0D.
    """
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    return few, repeated, 100 * upper > MOST_UPPER_PERCENT * len(text), MARKS.search(raw) is not None


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, key (128 bits of the text) and flags A to D of every document; a null text counts as empty."""
    source = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    schema = source.drop("text").schema.add("key", "binary")
    for name in FILTERS[:4]:
        schema = schema.add(name, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, flags = [], []
            for value in batch.column(2):
                text = value.as_py()
                keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                flags.append(text_failures(text))
            columns = [pa.array([f[i] for f in flags], pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), *columns], schema.names)

    return source.mapInArrow(run, schema)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, flags A to E, good, toxic: one row for each row of ``docs`` (doc_id, lang, text).

    E holds if a row with a smaller doc_id has the same text, whatever else happens to that row. Rows that share their
    doc_id don't make each other fail; a null doc_id counts as larger than all others. Null texts are empty texts, so all
    of these are identical. ``labels`` (doc_id, quality, toxic): a document is good or toxic if any of its label rows
    says so; null labels and labels without an id say nothing.

    Texts are read once. Hot texts and hot ids are split by the skew join: both sides of either join are stored rows.
    """
    rows = cut(_measured(docs))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    firsts = cut(rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"))
    marks = cut(
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        .select("_id", F.lit(0).alias("_spread"), "good", "toxic")
    )
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")).otherwise(0)
    told = rows.join(firsts, "key", "left").withColumn("_spread", spread)
    marked = told.join(marks, (F.col("doc_id") == F.col("_id")) & (told["_spread"] == marks["_spread"]), "left")
    no = F.lit(False)
    return marked.select(
        "doc_id", "part", *FILTERS[:4], F.coalesce(F.col("first") < place, no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def survivors(failed: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(part, passed, n, good, toxic): for every part and subset of the filters, what passes all of the subset.

    ``failed`` has part, a boolean for each filter, good and toxic. ``passed`` has bit i for ``filters[i]``. Every part has
    all subsets, also those that nothing survives.
    """
    flags = failed.groupBy("part", *filters).agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    # a row of weight 0 that fails nothing: so no subset of a part is missing
    blank = flags.select("part").distinct().select("part", *[F.lit(False).alias(f) for f in filters], *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    cube = flags.unionByName(blank).cube("part", *filters).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    whole = len(filters)
    kept = cube.where(F.col("level") < (1 << whole))
    for f in filters:
        kept = kept.where(F.coalesce(F.col(f), F.lit(False)) == F.lit(False))
    passed = sum(((1 - F.shiftright("level", whole - 1 - i).bitwiseAND(F.lit(1))) * (1 << i) for i in range(whole)), F.lit(0)).cast("int")
    return kept.select("part", passed.alias("passed"), "n", "good", "toxic")


def audit(failed: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters, for every part.

    kept: documents after the step; removed: by it; redundant: they fail its filter, but went before; unique_fails: they fail its
    filter only; good_lost, toxic_lost: of the removed; shapley: its filter's removed summed over all orders. A table without
    rows has no part and gives no row.
    """
    m, spark = len(filters), failed.sparkSession
    bit = {f: 1 << i for i, f in enumerate(filters)}
    mask = lambda some: sum(bit[f] for f in some)
    every = mask(filters)
    # of fixed size: the pairs of subsets that differ in one filter, and the steps of all orders
    pairs = [
        (f, mask(s), mask(s) | bit[f], factorial(len(s)) * factorial(m - 1 - len(s)), mask(s) == 0, mask(s) == every - bit[f])
        for f in filters for k in range(m) for s in combinations([x for x in filters if x != f], k)
    ]
    steps = [("".join(order), i + 1, f, mask(order[:i])) for order in permutations(filters) for i, f in enumerate(order)]
    pair = spark.createDataFrame(pairs, "filter string, before int, after int, orders long, first boolean, last boolean")
    step = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    left = cut(survivors(failed, filters))
    after = left.select("part", F.col("passed").alias("after"), F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
    gaps = (
        left.join(F.broadcast(pair), F.col("passed") == F.col("before"))
        .join(after, ["part", "after"])
        .select("part", "filter", "before", "orders", "first", "last", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"))
    )
    gaps = cut(gaps)
    only = lambda flag: F.sum(F.when(F.col(flag), F.col("removed")).otherwise(0))
    totals = gaps.groupBy("part", "filter").agg(only("first").alias("fails"), only("last").alias("unique_fails"), F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    found = gaps.join(totals, ["part", "filter"]).join(F.broadcast(step), ["filter", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all of ``docs``; extra columns of either table are not read."""
    return audit(failures(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(first < w.doc_id, w.doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
p AS (
  SELECT part, filter_order, fails, n, good, toxic,
    CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda y: instr(filter_order, y))) END AS gone
  FROM g, o),
r AS (
  SELECT part, p.filter_order, step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (WHERE gone > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone < step AND contains(fails, filter_order[step])), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = filter_order[step]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0) AS toxic_lost
  FROM p JOIN s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""

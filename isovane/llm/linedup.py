"""Line dedup over overlapping three-line windows, in DataFrame functions alone.

Every three consecutive lines are a window. A window that occurs again anywhere in the corpus is a repeat;
its first occurrence, by (doc_id, place), stays. All lines covered by later occurrences go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, body, at, h1, h2) for each window: its document, first line and two 64-bit hashes."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    at = F.sequence(F.lit(0), F.size("lines") - size)
    keys = F.transform(
        at,
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.get("lines", i + j) for j in range(size)]).alias("h1"),
            F.xxhash64(F.lit("second"), *[F.get("lines", i + j) for j in range(size)]).alias("h2"),
        ),
    )
    return lines.select("doc_id", "body", F.explode(keys).alias("k")).select("doc_id", "body", "k.at", "k.h1", "k.h2")


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, body, at) of every occurrence of a window but its first."""
    found = windows(docs, size)
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body", "at")
    firsts = found.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = found.join(firsts, ["h1", "h2"])
    return repeats.where(~where.eqNullSafe(F.col("first"))).select("doc_id", "body", "at")


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines``, ``n_removed``.

    Lines are what "\\n" separates. A text with fewer than ``size`` lines has no window and stays as it is,
    as do null texts (no line) and empty ones (one line). Windows that repeat within one text count too.
    Rows that share doc_id and text are one occurrence: each gets the same result. Null ids come last.
    Columns n_lines and n_removed of ``docs`` are replaced.
    """
    covered = (
        later_windows(docs, size)
        .groupBy("doc_id", "body")
        .agg(F.collect_set("at").alias("starts"))
        .select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "starts")
    )
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("own"))
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_body")), "left")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    staged = joined.select("row", "text", F.split("text", "\n", -1).alias("lines"), gone.alias("gone"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return staged.select(
        *[F.col("row")[c].alias(c) for c in columns],
        cleaned.alias("text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document after line dedup."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def keep_cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned texts and their n_chars; a text of which no line is left goes."""
    done = dedup_lines(docs)
    kept = done.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))))
    columns = [F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


ORACLE = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i AS place, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS body
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS i FROM docs)),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS r FROM w),
gone AS (SELECT DISTINCT doc_id, place + j AS line FROM (SELECT doc_id, place, unnest([0, 1, 2]) AS j FROM f WHERE r > 1)),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS body FROM docs),
m AS (SELECT l.doc_id, l.line, l.body, g.line IS NOT NULL AS gone FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM m GROUP BY doc_id
"""

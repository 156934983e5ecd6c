"""Chat formatting: one rendering of a dialogue for each participant, who becomes the assistant.

For every participant the whole dialogue is rendered: own turns as the assistant, others as users named after their
role, system turns as they are. ``spans`` are the character ranges of the participant's own contents, closing mark
included: what a loss is taken on. So that no row grows without bound, a rendering of more than ``PART_TURNS`` turns stands in
several rows: ``part`` counts them, ``start`` is where the row's text begins, and spans are places in the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered

PART_TURNS = 256
#: A table with more rows than this is joined, not broadcast.
BROADCAST_ROWS = 20_000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNNAMED = "unknown"


def _head(role: Column, speaker: Column) -> Column:
    name = F.regexp_replace(role, r"[\s<|>]+", "_")
    return F.when(role == "system", F.lit(OPEN + "system\n")).when(role == speaker, F.lit(OPEN + "assistant\n")).otherwise(F.concat(F.lit(OPEN + "user name="), name, F.lit("\n")))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _split(lines: DataFrame, longer: DataFrame, part_turns: int) -> DataFrame:
    """``lines`` of the dialogues ``longer`` with ``part``, by their place in the dialogue; no task sees a whole one."""
    some = lines.join(_few(longer), F.col("conv_id").eqNullSafe(F.col("l_conv")), "left_semi")
    placed = numbered(some, ["conv_id", "turn", "role", "text"], "place")
    firsts = cut(placed.groupBy(F.col("conv_id").alias("f_conv")).agg(F.min("place").alias("first")))
    return placed.join(_few(firsts), F.col("conv_id").eqNullSafe(F.col("f_conv"))).select("conv_id", F.floor((F.col("place") - F.col("first")) / part_turns).alias("part"), "turn", "role", "text")


def _rendered(lines: DataFrame, people: DataFrame) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_own, chat, spans), spans as places in ``chat``."""
    parts = lines.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    who = F.col("speaker")
    said = F.transform("turns", lambda t: F.struct(_head(t.role, who).alias("head"), F.concat(t.text, F.lit(CLOSE)).alias("body"), (t.role == who).alias("own")))
    rows = rows.select("conv_id", "part", "speaker", said.alias("said"))
    size = lambda c: F.length(c).cast("long")
    ends = F.aggregate(
        "said",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + size(t["head"]) + size(t.body)).alias("at"),
            F.when(t.own, F.concat(acc.spans, F.array(F.struct((acc.at + size(t["head"])).alias("start"), (acc.at + size(t["head"]) + size(t.body)).alias("end"))))).otherwise(acc.spans).alias("spans"),
        ),
    )
    return rows.select(
        "conv_id", "part", "speaker",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda t: t.own)).cast("long").alias("n_own"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t.body)), "").alias("chat"),
        ends["spans"].alias("spans"),
    )


def _joined_up(rendered: DataFrame) -> DataFrame:
    """Parts with ``start``, and spans as places in the whole rendering. Lengths alone are summed up, texts stay in place."""
    rendered = cut(rendered)
    before = Window.partitionBy("s_conv", "s_speaker").orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rendered.select(F.col("conv_id").alias("s_conv"), F.col("speaker").alias("s_speaker"), F.col("part").alias("s_part"), F.length("chat").cast("long").alias("size"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rendered.join(starts, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("speaker") == F.col("s_speaker")) & (F.col("part") == F.col("s_part")))
    moved = F.transform("spans", lambda s: F.struct((s.start + F.col("start")).alias("start"), (s.end + F.col("start")).alias("end")))
    return rows.withColumn("spans", moved)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_own, start, chat, spans) for every participant of every dialogue.

    Participants are the distinct roles of a dialogue but ``system``; a null or empty role is the speaker
    ``unknown``. A dialogue of system turns only gives no row. Turns are in order of (turn, role, text);
    repeated rows count once, turns that share a number are all kept. A null turn number comes first; a null text is an
    empty content. Rows with a null conversation id form one dialogue. A dialogue of at most ``part_turns`` turns is one
    row for each participant; the rows of a longer one, in order of ``part``, are one text. A part in
    which the participant is silent is rendered with no span. In names, white space and marks are "_"; in
    contents, the marks that open and close a message get a blank after their first character.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|im_(start|end)\|>", "< |im_$1|>")
    speaker = F.when(F.coalesce(F.trim(F.col(role)), F.lit("")) == "", UNNAMED).otherwise(F.col(role))
    lines = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), speaker.alias("role"), clean.alias("text")).distinct()
    people = lines.where(F.col("role") != "system").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    longer = cut(lines.groupBy(F.col("conv_id").alias("l_conv")).agg(F.count("*").alias("n")).where(F.col("n") > part_turns))
    names = ["conv_id", "part", "speaker", "n_turns", "n_own", "start", "chat", "spans"]
    short = lines.join(_few(longer), F.col("conv_id").eqNullSafe(F.col("l_conv")), "left_anti").withColumn("part", F.lit(0).cast("long"))
    whole = _rendered(short, people).withColumn("start", F.lit(0).cast("long")).select(names)
    if longer.isEmpty():
        return whole
    return whole.unionByName(_joined_up(_rendered(_split(lines, longer, part_turns), people)).select(names))


def digest(rendered: DataFrame) -> DataFrame:
    """``rotate``'s rows with spans as text, "start:end" joined by ",": comparable in any engine."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")
    return rendered.withColumn("spans", spans)


ORACLE = r"""
WITH lines AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn,
         CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE role END AS role,
         regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '< |im_\1|>', 'g') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM lines WHERE role <> 'system'),
said AS (
  SELECT l.conv_id, p.speaker, l.turn, l.role, l.text,
         CASE WHEN l.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN l.role = p.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(l.role, '[\s<|>]+', '_', 'g') || chr(10) END AS head,
         l.text || '<|im_end|>' || chr(10) AS body, l.role = p.speaker AS own
  FROM lines l JOIN people p ON l.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, (row_number() OVER whole - 1) // 256 AS part, sum(length(head) + length(body)) OVER whole AS stop
  FROM said WINDOW whole AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       CAST(min(stop - length(head) - length(body)) AS BIGINT) AS start,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS chat,
       coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, part, speaker
"""

"""Chat formatting by perspective: each participant in turn is the assistant, the others are named users. DataFrame functions only.

The result has a row per conversation, perspective and turn: the rendered segment, its place in the whole rendering (in
characters), and the span that training looks at, which is the perspective's own text with its end mark. The segments in
the order of ``ordinal`` are the rendering, so that no conversation is ever gathered into one value. Turns are dealt by
blocks of ``BLOCK`` turns: what comes before a block is known from counts and lengths by block and speaker, a small
table, and only within a block a window runs. The text is shuffled once, and a long conversation over many tasks.

Defined cases: a null role is the speaker ``unknown``; a null text is empty; a null turn comes first; a null
conversation is one conversation; equal turns are ordered by speaker and text, and repeated rows are said twice; a
conversation of system turns alone has no participant and no row; an empty table gives an empty table; a very long text is
one turn's segment; control marks in texts and names are broken up;
columns other than the named ones aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block.
BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Speakers who set the stage and have no perspective.
STAGE = ("system",)


def _name(speaker: Column) -> Column:
    return F.translate(speaker, "<|>\n\r", "___  ")


def _user_header(speaker: Column) -> Column:
    return F.when(speaker.isin(*STAGE), F.concat(F.lit(OPEN), speaker, F.lit("\n"))).otherwise(F.concat(F.lit(f"{OPEN}user name="), _name(speaker), F.lit("\n")))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """All perspectives of all conversations, a row per turn."""
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("said"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / block))
    own_header, close = f"{OPEN}assistant\n", f"{CLOSE}\n"
    size = F.char_length(_user_header(F.col("speaker"))) + F.char_length("said") + len(close)

    # By block: turns and length of each speaker; from these, what precedes the block in each perspective.
    sums = said.groupBy("conv_id", "block", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("size"))
    blocks = sums.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size")
    )
    people = sums.where(~F.col("speaker").isin(*STAGE)).groupBy("conv_id", "speaker").agg(F.sum("n").alias("all")).select("conv_id", F.col("speaker").alias("perspective"))
    views = blocks.alias("b").join(people.alias("p"), F.col("b.conv_id").eqNullSafe(F.col("p.conv_id"))).select("b.conv_id", "b.block", "b.n", "b.size", "p.perspective")
    mine = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.col("speaker").alias("s"), F.col("n").alias("own"))
    views = views.join(mine, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")) & (F.col("perspective") == F.col("s")), "left")
    own_before = F.coalesce(F.sum("own").over(Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = F.char_length(_user_header(F.col("perspective"))) - len(own_header)
    views = views.select("conv_id", "block", "perspective", F.col("n").alias("n0"), (F.col("size") - own_before * gain).alias("at0"))

    # The text moves once; the windows within a block need no further exchange.
    views = views.withColumnsRenamed({"conv_id": "c", "block": "k"})
    rows = said.join(views, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).drop("c", "k")
    is_own = F.col("speaker") == F.col("perspective")
    header = F.when(is_own, F.lit(own_header)).otherwise(_user_header(F.col("speaker")))
    rows = rows.withColumns({"header": header, "target": is_own}).withColumn("segment", F.concat("header", "said", F.lit(close)))
    order = Window.partitionBy("conv_id", "block", "perspective").orderBy("turn", "speaker", "said")
    ends = F.sum(F.char_length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"ordinal": F.col("n0") + F.row_number().over(order) - 1, "seg_end": F.col("at0") + ends})
    start = F.col("seg_end") - F.char_length("segment")
    return rows.select(
        "conv_id", "perspective", "ordinal", "turn", "speaker",
        F.when(F.col("target"), "assistant").when(F.col("speaker").isin(*STAGE), F.col("speaker")).otherwise("user").alias("chat_role"),
        "segment", start.alias("seg_start"), "seg_end", "target",
        F.when(F.col("target"), start + F.char_length("header")).alias("target_start"),
        F.when(F.col("target"), F.col("seg_end") - 1).alias("target_end"),
    )


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), views AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.said, s.speaker = p.perspective AS target,
    CASE WHEN s.speaker = p.perspective THEN '{OPEN}assistant' || chr(10)
         WHEN s.speaker = 'system' THEN '{OPEN}system' || chr(10)
         ELSE '{OPEN}user name=' || translate(s.speaker, '<|>' || chr(10) || chr(13), '___  ') || chr(10) END AS header
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), whole AS (
  SELECT *, header || said || '{CLOSE}' || chr(10) AS segment FROM views
), placed AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal,
    CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg_end
  FROM whole
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said)
)
SELECT conv_id, perspective, ordinal, turn, speaker,
  CASE WHEN target THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role,
  segment, seg_end - length(segment) AS seg_start, seg_end, target,
  CASE WHEN target THEN seg_end - length(segment) + length(header) END AS target_start,
  CASE WHEN target THEN seg_end - 1 END AS target_end
FROM placed
"""

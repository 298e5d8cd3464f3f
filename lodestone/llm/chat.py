"""Multi-party chat formatting by perspective rotation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Turn numbers whose rows are summed together, and distinct rows of one turn number that are.
BLOCK_TURNS, MOST_TOGETHER = 256, 4096


def perspective_rotation(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system_names: tuple[str, ...] = ("system",),
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Render each dialogue once for every participant, that speaker being the assistant.

    A participant is any speaker of the conversation outside ``system_names``. From its
    perspective its own turns have role ``assistant``, system turns ``system`` and all other
    turns ``user``; users keep their speaker's name. One row is returned for each
    (conversation, perspective, turn):

    conv_id, perspective, position (from 0), turn, role, name, segment (the rendered text
    ``<|role|>`` or ``<|user:name|>``, newline, text, newline, ``<|end|>``, newline),
    is_target, char_start and char_end (of the segment in the rendered dialogue), mask_start
    and mask_end (the trained characters: the assistant's text and its end mark; both null
    where is_target is false). Joining the segments by position gives the dialogue. Rows stay
    single turns, so that a conversation of any length never meets in one task.

    Turns are ordered by (turn, md5 of speaker and text), null turns last. Equal turns become one
    row with a number of copies before anything moves, and positions are summed on rows without
    texts, in three levels: a piece of the rows of one turn number, ``block_turns`` turn numbers,
    the conversation. So a conversation, a turn number or a turn that holds much of the table is
    spread over tasks. Texts are joined to the placed rows at the end.

    Edge cases: null text is empty; a null speaker is a participant named ``unknown``; a null
    conversation id is one conversation of its own; repeated rows are repeated turns; a
    conversation of system turns only has no participant and gives no rows; an empty table
    gives an empty result. Other columns are ignored.
    """
    speaker, text = F.coalesce(F.col(speaker_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    base = written(
        turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), text.alias("text"))
        .groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
        .withColumn("key", F.md5(F.concat(F.col("speaker"), F.lit("\n"), F.col("text")))).withColumn("text_len", F.length("text").cast("long")), "chat-turns",
    )
    most = base.groupBy("conv_id", "turn").count().agg(F.max("count")).first()[0] or 0
    digits = 0  # of the key, that cut the rows of one turn number into pieces
    while most > MOST_TOGETHER << 4 * digits:
        digits += 1
    people = (
        base.filter(~F.col("speaker").isin(*system_names)).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    )
    role = (
        F.when(F.col("speaker").isin(*system_names), "system")
        .when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    )
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|"), "role", F.lit("|>\n"))
    )
    close = "\n<|end|>\n"
    narrow = base.select("conv_id", "turn", "speaker", "key", "copies", "text_len")
    seen = (
        narrow.join(people, narrow["conv_id"].eqNullSafe(people["conv"])).withColumn("role", role)
        .withColumns({
            "head_len": F.length(head), "piece": F.substring("key", 1, digits),
            "block": F.coalesce(F.floor(F.col("turn") / block_turns), F.lit((1 << 62) // block_turns)),
        })
        .withColumn("chars", F.col("head_len") + F.col("text_len") + len(close)).drop("conv", "text_len")
    )
    sums = seen.groupBy("conv_id", "perspective", "block", "turn", "piece").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("chars")).alias("size"))
    of_block = sums.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))

    def before(df: DataFrame, window, *columns: str) -> DataFrame:
        """What stands before each row; the key columns get names of their own."""
        w = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*(F.col(c).alias(f"{c}_{len(columns)}") for c in columns),
                         F.coalesce(F.sum("n").over(w), F.lit(0)).alias(f"n_{len(columns)}"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias(f"size_{len(columns)}"))

    by_turn = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "piece")
    pieces = before(sums, by_turn, "conv_id", "perspective", "block", "turn", "piece")
    blocks = before(of_block, Window.partitionBy("conv_id", "perspective").orderBy("block"), "conv_id", "perspective", "block")

    def same(df: DataFrame, other: DataFrame, n: int, *columns: str):
        out = F.lit(True)
        for c in columns:
            out = out & df[c].eqNullSafe(other[f"{c}_{n}"])
        return out

    within = Window.partitionBy("conv_id", "perspective", "block", "turn", "piece").orderBy("key", "speaker").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumns({"n_0": F.coalesce(F.sum("copies").over(within), F.lit(0)), "size_0": F.coalesce(F.sum(F.col("copies") * F.col("chars")).over(within), F.lit(0))})
    placed = placed.join(pieces, same(placed, pieces, 5, "conv_id", "perspective", "block", "turn", "piece"))
    placed = placed.join(blocks, same(placed, blocks, 3, "conv_id", "perspective", "block")).select(
        "conv_id", "turn", "speaker", "key", "perspective", "role", "head_len", "chars", "copies",
        F.expr("n_0 + n_3 + n_5").alias("n"), F.expr("size_0 + size_3 + size_5").alias("size"))
    texts = base.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("speaker").alias("s"), F.col("key").alias("k"), "text")
    whole = placed.join(texts, placed["conv_id"].eqNullSafe(texts["c"]) & placed["turn"].eqNullSafe(texts["t"]) & (F.col("speaker") == F.col("s")) & (F.col("key") == F.col("k")))
    target = F.col("role") == "assistant"
    return whole.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("char_start", F.expr("size + copy * chars")).select(
        "conv_id", "perspective", F.expr("n + copy").alias("position"), "turn", "role", F.col("speaker").alias("name"), F.concat(head, "text", F.lit(close)).alias("segment"),
        target.alias("is_target"), "char_start", F.expr("char_start + chars").alias("char_end"),
        F.when(target, F.col("char_start") + F.col("head_len")).alias("mask_start"),
        F.when(target, F.expr("char_start + chars - 1")).alias("mask_end"),
    )


#: The same over the table ``conversations``, for a check by another engine.
ROTATION_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM base WHERE speaker <> 'system'
), seen AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM base JOIN people ON conv_id IS NOT DISTINCT FROM conv
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|user:' || speaker || '|>' || chr(10) ELSE '<|' || role || '|>' || chr(10) END AS head FROM seen
), segments AS (
  SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS char_end
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn ASC NULLS LAST, md5(speaker || chr(10) || text))
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, speaker AS name, segment,
  role = 'assistant' AS is_target,
  CAST(char_end - length(segment) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
  CAST(CASE WHEN role = 'assistant' THEN char_end - length(segment) + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN char_end - 1 END AS BIGINT) AS mask_end
FROM placed
"""

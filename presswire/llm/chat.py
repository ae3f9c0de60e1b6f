"""Chat formatting: multi-party perspective rotation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Characters that a name may not hold, and what stands for them (per cent codes, so that different
#: speakers have different names). The per cent sign comes first.
NAME_CODES = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\v": "%0B", "\f": "%0C", "\r": "%0D", "<": "%3C", "=": "%3D", ">": "%3E", "|": "%7C"}
#: The name of a null speaker; no code yields it.
UNNAMED = "%unknown"


def name(c: Column) -> Column:
    """A speaker's name in a header."""
    for char, code in NAME_CODES.items():
        c = F.replace(c, F.lit(char), F.lit(code))
    return F.coalesce(c, F.lit(UNNAMED))


def escape(c: Column) -> Column:
    """A text that holds no marker: every ``<|``, with any backslashes between, gets one backslash
    more there. :func:`unescape` takes it away again."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each turn of each rendering; a conversation has one rendering for every
    participant, in which that participant is the assistant and the others are named users.

    Columns: ``conv_id, perspective, turn, speaker, header, body, footer, loss, loss_start,
    loss_end``. The rendered turn is ``header || body || footer``; ``loss`` is true where the
    perspective's participant speaks and ``[loss_start, loss_end)`` are then the characters of
    the rendered turn that are trained on (body and footer), else both are equal. The rendering
    of a dialogue is its rows in the order of ``turn``, and of equal turns in that of speaker and
    body (nulls first); see :func:`transcripts`. Rows stay apart so that no conversation, however
    long, has to fit in one task; a body of any length is rendered whole.

    Markers in a text are escaped, so that no text can pass for a turn, and names are coded, so
    that different speakers stay different (see :func:`escape`, :func:`name`). Speakers in
    ``context`` give instructions: they are rendered in every perspective and have none
    themselves; a conversation of such turns only has no rendering. A null speaker is one
    participant, other than any named one; a null text is empty, null conversation ids form one
    conversation, a null turn stays null and sorts first. Repeated rows are rendered as often as
    they occur; an empty table gives an empty result. Other columns, whatever their names, are
    ignored. A conversation's turns and participants meet on its id: of one that holds many rows,
    adaptive execution splits the turns over tasks.
    """
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("speaker"), escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("body"))
    instructs = F.coalesce(F.col("speaker").isin(*context), F.lit(False))
    people = turns.where(~instructs).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(instructs, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name(F.col("speaker"))))
    out = turns.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "conv_id", "perspective", "turn", "speaker", F.concat(F.lit(START), role, F.lit("\n")).alias("header"), "body", F.lit(END + "\n").alias("footer"), own.alias("loss")
    )
    end = F.length("header") + F.length("body") + F.lit(len(END) + 1)
    return out.withColumn("loss_start", F.when(F.col("loss"), F.length("header")).otherwise(end)).withColumn("loss_end", end)


def transcripts(rendered: DataFrame) -> DataFrame:
    """Whole renderings: ``conv_id, perspective, n_turns, rendered, mask`` with ``mask`` the
    trained character ranges of ``rendered``. For conversations that fit in memory."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "speaker", "body", "header", "footer", "loss", "loss_start", "loss_end")))
    width = lambda x: F.length(x["header"]) + F.length(x["body"]) + F.length(x["footer"])
    g = rendered.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    step = lambda acc, x: F.struct(
        (acc["at"] + width(x)).alias("at"),
        F.when(x["loss"], F.array_append(acc["mask"], F.struct((acc["at"] + x["loss_start"]).alias("start"), (acc["at"] + x["loss_end"]).alias("end")))).otherwise(acc["mask"]).alias("mask"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))
    return g.select(
        "conv_id",
        "perspective",
        F.size("p").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["header"], x["body"], x["footer"])), "").alias("rendered"),
        F.aggregate("p", empty, step)["mask"].alias("mask"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation in the rendering of every participant."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rotate(c).select(
        "conv_id", "perspective", "turn", "speaker", F.concat("header", "body", "footer").alias("rendered"), "loss", F.col("loss_start").cast("long").alias("loss_start"), F.col("loss_end").cast("long").alias("loss_end")
    )


_CODED = "speaker"
for _char, _code in NAME_CODES.items():
    _CODED = f"replace({_CODED}, chr({ord(_char)}), '{_code}')"

OP6_SQL = rf"""
WITH t AS (SELECT conv_id, turn, role AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
j AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.body, t.speaker IS NOT DISTINCT FROM p.perspective AS loss,
    '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker IS NOT DISTINCT FROM p.perspective THEN 'assistant'
      ELSE 'user name=' || coalesce({_CODED}, '{UNNAMED}') END || chr(10) AS header
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, turn, speaker, header || body || '<|im_end|>' || chr(10) AS rendered, loss,
  CAST(CASE WHEN loss THEN length(header) ELSE length(header) + length(body) + 11 END AS BIGINT) AS loss_start,
  CAST(length(header) + length(body) + 11 AS BIGINT) AS loss_end
FROM j
"""

TRANSCRIPTS_SQL = f"""
WITH r AS ({OP6_SQL})
SELECT conv_id, perspective, CAST(count(*) AS INTEGER) AS n_turns, string_agg(rendered, '' ORDER BY turn NULLS FIRST, speaker NULLS FIRST, rendered) AS rendered,
  CAST(sum(CASE WHEN loss THEN loss_end - loss_start ELSE 0 END) AS BIGINT) AS n_trained
FROM r GROUP BY ALL
"""


def chat_transcripts(spark, sf_dir: str) -> DataFrame:
    """Whole dialogues in the rendering of every participant."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return transcripts(rotate(c)).select("conv_id", "perspective", "n_turns", "rendered", trained.alias("n_trained"))

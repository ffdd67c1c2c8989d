"""Dialogues rendered once from the perspective of each of their participants.

For every participant, the whole dialogue is rendered with that speaker as the assistant, the other
speakers as named users and context roles (system, tool) as they are; the loss mask covers what that
speaker said, with its end mark. A dialogue of any length comes in *parts* of ``PART_MESSAGES``
messages, each with the place where its text begins in the whole rendering: parts of one perspective,
in order, put together are that rendering. Messages are numbered through ranges of all of them, so no
group and no sort holds more than a range or a part, whatever the turn numbers are, and where a part
begins is a running sum over one short row for each part.

DataFrame functions only.

Cases: null texts are empty messages and null roles speak as ``unknown``; null turns come first;
several messages with one turn number are ordered by speaker and text; rows that repeat a message
exactly (same conversation, turn, role and text) are one message; rows without ``conv_id`` form one
conversation, null; a dialogue of context roles alone has no participants and no rows; the beginning
of a mark (``<|``) within a text or name is written ``<\\|``, so that no message can forge a turn; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.store import with_ids

#: Fixed values of the rendering.
ASSISTANT, NAMED_USER, CONTEXT, AFTER_NAME, END, LINE = "<|assistant|>\n", "<|user name=", "<|", "|>\n", "<|end|>", "\n"
CONTEXT_ROLES = ("system", "tool")
MARK, ESCAPED = "<|", "<\\|"
PART_MESSAGES = 64


def _messages(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``turn``, ``speaker`` and ``text`` of each message."""
    safe = lambda c: F.replace(c, F.lit(MARK), F.lit(ESCAPED))
    messages = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        safe(F.coalesce(turns["role"], F.lit("unknown"))).alias("speaker"),
        safe(F.coalesce(turns["text"], F.lit(""))).alias("text"),
    ).distinct()
    numbered = with_ids(messages, 0, ["conv_id", "turn", "speaker", "text"], "number")
    first = numbered.groupBy(F.col("conv_id").alias("of")).agg(F.min("number").alias("first"))
    part = F.floor((F.col("number") - F.col("first")) / PART_MESSAGES).cast("long")
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", part.alias("part"), "turn", "speaker", "text")


def _before(message: Column, perspective: Column) -> Column:
    """What stands before a message's text."""
    speaker = message["speaker"]
    return F.when(speaker.isin(*CONTEXT_ROLES), F.concat(F.lit(CONTEXT), speaker, F.lit(AFTER_NAME))).when(speaker == perspective, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(NAMED_USER), speaker, F.lit(AFTER_NAME)))


def perspectives(turns: DataFrame) -> DataFrame:
    """One row for each conversation, participant and part.

    ``conv_id``, ``speaker``, ``part``, ``n_turns``, ``char_start`` (where the part's text begins in
    the whole rendering), ``text``, ``spans`` (array of start and end, in characters of this part's
    text, of what is learned) and ``n_learned`` (characters in the spans).
    """
    messages = _messages(turns)
    parts = messages.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("messages"))
    speakers = messages.where(~F.col("speaker").isin(*CONTEXT_ROLES)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["of"])).drop("of")
    said = F.transform("messages", lambda m: F.struct(_before(m, F.col("perspective")).alias("before"), m["text"].alias("text"), (m["speaker"] == F.col("perspective")).alias("learned")))
    said = own.select("conv_id", "part", "perspective", said.alias("said"))
    text = F.array_join(F.transform("said", lambda s: F.concat(s["before"], s["text"], F.lit(END + LINE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(held: Column, s: Column) -> Column:
        begin = held["at"] + F.length(s["before"])
        end = begin + F.length(s["text"]) + len(END)
        return F.struct((end + len(LINE)).alias("at"), F.when(s["learned"], F.concat(held["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(held["spans"]).alias("spans"))

    walked = F.aggregate("said", start, add)
    rendered = said.select("conv_id", F.col("perspective").alias("speaker"), "part", F.size("said").cast("long").alias("n_turns"), text.alias("text"), walked.alias("walked"))
    rendered = rendered.select("conv_id", "speaker", "part", "n_turns", "text", F.col("walked.at").cast("long").alias("size"), F.col("walked.spans").alias("spans"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rendered.select("conv_id", "speaker", "part", "size").select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("char_start"))
    learned = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return rendered.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("part") == F.col("p"))).select("conv_id", "speaker", "part", "n_turns", "char_start", "text", "spans", learned.alias("n_learned"))


def perspective_table(turns: DataFrame) -> DataFrame:
    """``perspectives`` with the spans as text, ``start-end`` joined by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return perspectives(turns).withColumn("spans", spans)


ORACLE = f"""
WITH m AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') AS speaker, replace(coalesce(text, ''), '<|', '<\\|') AS text FROM conversations),
m2 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1) // {PART_MESSAGES} AS part FROM m),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker NOT IN ('system', 'tool')),
r AS (SELECT m2.conv_id, perspective, part, turn, speaker, text, speaker = perspective AS learned,
  CASE WHEN speaker IN ('system', 'tool') THEN '<|' || speaker || '|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS before
  FROM m2 JOIN p ON m2.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, length(before) + length(text) + 8 AS size, before || text || '<|end|>' || chr(10) AS segment FROM r),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(before) AS a FROM s),
g AS (SELECT conv_id, perspective AS speaker, part, count(*) AS n_turns, sum(size) AS size, string_agg(segment, '' ORDER BY turn NULLS FIRST, speaker, text) AS text,
  coalesce(string_agg(CASE WHEN learned THEN CAST(a AS BIGINT) || '-' || CAST(a + length(text) + 7 AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, speaker, text), '') AS spans,
  CAST(coalesce(sum(CASE WHEN learned THEN length(text) + 7 END), 0) AS BIGINT) AS n_learned FROM w GROUP BY ALL)
SELECT conv_id, speaker, part, n_turns, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, text, spans, n_learned FROM g
"""

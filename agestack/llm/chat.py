"""Chat formatting: every dialogue from the point of view of each of its speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Roles that set the scene and are nobody's own turns; their messages keep their role in every view.
CONTEXT_ROLES = ("system",)


def _clean(text: Column) -> Column:
    """Text that cannot be taken for a control mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, segment_turns: int = 256) -> DataFrame:
    """One row per conversation, speaker and segment: the dialogue with that speaker as the assistant.

    Columns ``conv_id, speaker, segment, n_messages, text, spans, n_masked``.  The speaker's messages are headed
    ``assistant``, those of others ``user name=...``, those of ``context_roles`` keep their role.  ``spans`` are the
    ranges of characters (start, end exclusive) to train on: the speaker's contents with their end marks; everything
    else is masked, ``n_masked`` characters in all.

    Messages stand in the order of turn, role and text, null turns first; a segment holds the messages of
    ``segment_turns`` consecutive turn numbers, so a conversation of any length is cut into bounded rows (a null turn
    belongs to segment 0).  Null texts are empty messages.  A null or empty role is the speaker ``unknown``.  Rows that
    repeat are messages of their own.  A null conv_id is a conversation of its own.  A conversation with context alone
    has no speaker and no row.  A segment without a message of the speaker is rendered too, all masked.
    """
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", "unknown").otherwise(_clean(F.col("role")))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), _clean(F.col("text")).alias("content"),
        F.coalesce(F.floor(F.col("turn") / segment_turns).cast("long"), F.lit(0).cast("long")).alias("segment"))
    rows = rows.withColumn("__conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.withColumn("__none", F.col("conv_id").isNull())
    speakers = (
        rows.filter(~F.col("role").isin(*context_roles)).groupBy("__conv", "__none")
        .agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    )
    segments = rows.groupBy("__conv", "__none", "segment").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))
    views = segments.join(speakers, ["__conv", "__none"]).select(
        "conv_id", "segment", F.size("messages").alias("n_messages"), "messages", F.explode("speakers").alias("speaker"))
    shown = f"""transform(messages, m -> named_struct(
        'head', concat('{START}', case when m.role = speaker then 'assistant'
                                       when array_contains({_array(context_roles)}, m.role) then m.role
                                       else concat('user name=', m.role) end, '\\n'),
        'body', concat(m.content, '{END}'), 'own', m.role = speaker))"""
    views = views.withColumn("shown", F.expr(shown))
    spans = """aggregate(shown, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
        (a, m) -> named_struct(
            'at', a.at + char_length(m.head) + char_length(m.body) + 1,
            'spans', if(m.own, concat(a.spans, array(named_struct(
                'start', a.at + char_length(m.head), 'end', a.at + char_length(m.head) + char_length(m.body)))), a.spans)),
        a -> a.spans)"""
    views = views.select(
        "conv_id", "speaker", "segment", F.col("n_messages").cast("long").alias("n_messages"),
        F.expr("concat_ws('', transform(shown, m -> concat(m.head, m.body, '\\n')))").alias("text"),
        F.expr(spans).alias("spans"))
    trained = F.expr("aggregate(spans, 0, (s, x) -> s + x.end - x.start)")
    return views.withColumn("n_masked", (F.char_length("text") - trained).cast("long"))


def _array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")" if values else "array('')"

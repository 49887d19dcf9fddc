"""Chat formatting from an event log: partition by conversation, order by sequence, fold streamed deltas,
edits and regenerations into final messages, then render. DataFrame functions only.

The log has ``conv_id, turn, seq, kind, role, text``; the fold of a turn:

* ``message`` and ``regenerate`` set the text anew (a regeneration drops what was streamed before it),
* ``delta`` appends to it,
* ``edit`` replaces it, and deltas after it append to the edited text,
* ``delete`` removes the turn, until a later event sets it again; deltas that come after it are lost with it.

A log may deliver an event twice: events of a turn that are equal in seq, kind, role and text are one. So a turn's text is that of its last
setting event and of the deltas after it, and there is none if that event is a deletion; its role is the last one named. Turns fold one by one, before conversations are put together, so that a long stream is never
gathered with the rest of its conversation.

A turn is rendered as ``### role: text</turn>`` and a line end. Inside texts and roles the control
characters are written as two characters each, so that neither ``#`` nor ``<`` nor, in roles, ``:`` is
left, and no text can imitate a marker; the change is undone exactly by ``unescape``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: Character and what stands for it; the backslash goes first when escaping and last when reading.
CODES = [("\\", "\\0"), ("#", "\\1"), ("<", "\\2"), (":", "\\3")]
LOSS_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    for plain, code in CODES if role else CODES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of an event log.

    Unknown kinds count as ``message``; a null kind too. A null text is empty, a null role empty unless
    another event of the turn names one. Ties of seq follow (kind, role, text), a null seq comes first; events that are equal in all of
    these count once. Very long texts are folded whole. Other columns are ignored; an empty table gives none.
    """
    rank = F.struct("seq", "kind", "role", "text")
    sets = F.when(~F.col("kind").isin("delta"), rank)
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id", "turn").orderBy(F.col("seq").desc(), F.col("kind").desc(), F.col("role").desc(), F.col("text").desc())
    # events after the last setting one, and that one: none that sets stands above them
    e = e.withColumn("above", F.coalesce(F.sum(F.when(sets.isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    once = F.lag(F.struct("seq", "kind", "role", "text")).over(w).eqNullSafe(F.struct("seq", "kind", "role", "text"))
    e = e.withColumn("again", once)
    e = e.withColumn("named", F.max_by("role", F.when(F.col("role").isNotNull(), rank)).over(Window.partitionBy("conv_id", "turn")))
    e = e.where("above = 0 and not again")
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    out = e.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "delete", 1).otherwise(0)).alias("gone"), F.first("named").alias("role"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return out.where("gone = 0").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the rendered text and the (start, end) code points in it of the
    assistant's texts. Turns that tie follow (role, text)."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumns({"head": F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(SEP)), "body": escape(F.col("text"))})
    m = m.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = m.withColumns({"n": F.row_number().over(order), "at": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")})
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    line = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("line"), span.alias("span"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return m.select(
        "conv_id",
        F.array_join(F.transform("x", lambda r: r["line"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def chat_format(events: DataFrame) -> DataFrame:
    """Fold an event log and render it: ``conv_id, formatted, loss_spans``.

    A null conv_id is a conversation of its own; very long texts are rendered whole. An empty table gives an empty result; columns other than
    those named above are ignored.
    """
    return render(fold_events(events))


def read_back(rendered: DataFrame) -> DataFrame:
    """The digest of each conversation, from the rendered text and its loss spans alone."""
    r = rendered.withColumn("pieces", F.split("formatted", CLOSE)).withColumn("turns", F.slice("pieces", 1, F.size("pieces") - 1))
    role = lambda t: unescape(F.substring_index(t, SEP, 1).substr(len(OPEN) + 1, 1 << 30))
    pair = F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), unescape(_after(t)), F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(pair, ""), 256).alias("turns_sha256"),
        loss.alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _after(t: Column) -> Column:
    """What follows the first separator of a turn."""
    head = F.length(F.substring_index(t, SEP, 1)) + len(SEP)
    return t.substr(head + 1, F.length(t))


def events_of(conversations: DataFrame, piece: int = 64) -> DataFrame:
    """A table of finished turns as the event log that could have led to them, in no order.

    Rows that share a turn stay turns of their own: the turn of the log is the row's place in its conversation, by (turn,
    role, text). An assistant's text is streamed in pieces of ``piece`` characters; every third such turn first streams a
    draft that a regeneration drops. Any other text is sent whole, but every third one first in another wording that an
    edit mends, its second half appended after the edit. A turn after the last is sent and deleted again.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.select("conv_id", F.row_number().over(w).alias("turn"), "role", "text", F.length("text").alias("size"))
    event = lambda seq, kind, text, role="role": F.struct(F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), (F.col(role) if role else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    part = lambda a, n: F.substring(F.col("text"), a, n)
    again, half = F.col("turn") % 3 == 0, F.floor(F.col("size") / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / piece).cast("int")), lambda i: event(i + 10, "delta", part(i * piece + 1, F.lit(piece)), None))
    draft = F.array(event(0, "message", F.lit("")), event(1, "delta", F.lit("a draft ### that "), None), event(2, "delta", F.lit("goes</turn>"), None), event(3, "regenerate", F.lit("")))
    streamed = F.concat(F.when(again, draft).otherwise(F.array(event(0, "message", F.lit("")))), pieces)
    edited = F.array(event(0, "message", F.lit("another wording")), event(1, "delta", F.lit(", and more"), None), event(2, "edit", part(1, half), None), event(3, "delta", F.col("text").substr(half + 1, F.col("size")), None))
    sent = F.when(F.col("role") == LOSS_ROLE, streamed).when(again, edited).otherwise(F.array(event(0, "message", F.col("text"))))
    log = c.select("conv_id", "turn", F.explode(sent).alias("e")).select("conv_id", "turn", "e.*")
    gone = F.array(event(0, "message", F.lit("never mind"), "role"), event(1, "delete", F.lit(None).cast("string"), None))
    last = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("user")).select("conv_id", "turn", F.explode(gone).alias("e")).select("conv_id", "turn", "e.*")
    return log.union(last)


FIXED_TEXT = "\\### Assistant: </turn> ok"


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the fixed one, as an event log of deltas, edits, regenerations and deletions, folded, rendered and
    read back; rows as ``read_back`` has them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FIXED_TEXT).alias("text")
    )
    return read_back(chat_format(events_of(c.union(more))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *,
    replace(replace(replace(text, '\', '\0'), '#', '\1'), '<', '\2') AS body,
    replace(replace(replace(replace(role, '\', '\0'), '#', '\1'), '<', '\2'), ':', '\3') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

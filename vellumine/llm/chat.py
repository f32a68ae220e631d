"""Chat formatting from event logs, in DataFrame functions only.

A log has one row per event: (conv_id, msg, seq, kind, role, text). ``msg`` names a message within
its conversation and orders messages; ``seq`` orders events. Kinds:

- ``start``: the message begins; ``role`` is its role.
- ``delta``: ``text`` is added at the end.
- ``edit``: ``text`` replaces what the message held.
- ``regenerate``: what the message held goes, and so do messages behind it that had begun by then.

Folding is done message by message, so a conversation with very many events is spread over tasks
and only its final messages meet. The template writes each turn as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

with ``~`` in roles and texts written as ``~0``, ``<`` as ``~1``, ``[`` as ``~2`` and, in roles,
a newline as ``~3``. No control string of this or of bracket templates can then stand in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))
    return F.replace(out, F.lit("\n"), F.lit("~3")) if role else out


def unescape(text: Column) -> Column:
    # Every ~ is followed by its digit, so the order of these replacements loses nothing: ~0 goes last.
    out = F.replace(F.replace(F.replace(text, F.lit("~3"), F.lit("\n")), F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log.

    A message without a ``start`` has the role of its first event that names one, else an empty one. Null
    texts count as empty, unknown kinds are ignored. Events of one message with equal ``seq`` are taken
    in the order of kind and text; a message whose conversation is null belongs to conversation null.
    Other columns are left out; an empty log has no messages.
    """
    known = events.where(F.col("kind").isin("start", "delta", "edit", "regenerate")).select(
        "conv_id", "msg", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    resets = F.col("kind").isin("edit", "regenerate")
    messages = known.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("began"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("named"),
        F.max(F.when(resets, F.struct("seq", "kind"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", "kind", "text")))).alias("pieces"),
    )
    # what the last edit put in, if that came last, and the pieces behind it
    at = lambda p: F.struct(p["seq"].alias("seq"), p["kind"].alias("kind"))
    put = F.slice(F.filter("pieces", lambda p: at(p) == F.col("reset")), -1, 1)
    after = F.when(F.col("reset").isNull(), F.col("pieces")).otherwise(F.concat(put, F.filter("pieces", lambda p: at(p) > F.col("reset"))))
    messages = messages.select(
        "conv_id", "msg", "began", "regenerated", F.coalesce("named.role", F.lit("")).alias("role"), F.array_join(F.transform(after, lambda p: p["text"]), "").alias("text")
    )
    # A regeneration takes back later messages that began before it. The window leaves rows dealt by conversation,
    # so rendering needs no other shuffle.
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    folded = messages.withColumn("_cut", F.max("regenerated").over(earlier))
    return folded.where(F.col("_cut").isNull() | ~(F.col("_cut") > F.col("began"))).select("conv_id", "msg", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the loss mask.

    ``loss`` has a struct (turn, start, length) per assistant message: the turn from 0, and the place of
    its escaped text, in code points from 1, within the turn, which is what stands behind a start
    mark up to the next end mark. Turns come in the order of ``msg``. Null roles and texts are empty, other columns are left out.
    """
    role, text = escape(F.coalesce("role", F.lit("")), role=True), escape(F.coalesce("text", F.lit("")))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "role", role.alias("mark"), text.alias("body")))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["mark"], F.lit("\n"), t["body"], F.lit(END))), "")
    places = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), (F.length(t["mark"]) + 2).alias("start"), F.length(t["body"]).alias("length"), (t["role"] == "assistant").alias("on")))
    loss = F.transform(F.filter(places, lambda p: p["on"]), lambda p: F.struct(p["turn"].alias("turn"), p["start"].alias("start"), p["length"].alias("length")))
    return turns.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` array<struct<role, text>> and ``loss_texts`` array<string>, both from the formatted text.

    Columns of these two names are replaced, others stay. A null ``formatted`` gives nulls.
    """
    parts = F.transform(F.filter(F.split("formatted", F.lit("<\\|im_end\\|>\n")), lambda x: x != ""), lambda x: F.substring(x, len(START) + 1, 2147483647))
    df = rendered.withColumn("_chat_parts", parts)
    turns = F.transform("_chat_parts", lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.element_at("_chat_parts", s["turn"] + 1), s["start"], s["length"])))
    return df.withColumn("turns", turns).withColumn("loss_texts", loss).drop("_chat_parts")


def events_of_rows(conversations: DataFrame, chunk: int = 200) -> DataFrame:
    """An event log that ends in the rows of a table (conv_id, turn, role, text), by streamed deltas.

    User rows begin with a draft that an edit replaces; assistant rows with a first attempt that a
    regeneration takes back before the text streams in ``chunk`` code points at a time. Rows that repeat
    stay apart, null texts are empty, other columns are left out. The cost is linear in the text.
    """
    row = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    msg = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("text").alias("text"), "row")
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))  # one walk over the text; a dot is a code point
    event = lambda kind, text, k: F.struct(F.lit(kind).alias("kind"), text.alias("text"), k.cast("long").alias("k"))
    deltas = F.transform(parts, lambda p, i: event("delta", p, i + 3))
    tried = F.substring("text", 1, 20)
    streamed = F.concat(F.array(event("start", F.lit(""), F.lit(0)), event("delta", tried, F.lit(1)), event("regenerate", F.lit(""), F.lit(2))), deltas)
    edited = F.array(event("start", F.lit(""), F.lit(0)), event("delta", tried, F.lit(1)), event("edit", F.col("text"), F.lit(2)))
    log = row.select("conv_id", msg.alias("msg"), F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "msg", F.struct(F.col("msg.turn").alias("turn"), F.col("msg.role").alias("role"), F.col("msg.text").alias("text"), F.col("msg.row").alias("row"), F.col("e.k").alias("k")).alias("seq"), "e.kind", F.when(F.col("e.kind") == "start", F.col("msg.role")).alias("role"), "e.text")

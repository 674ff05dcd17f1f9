"""Chat formatting from event logs, with DataFrame functions only.

A log has one row an event: conv_id, seq, turn, kind, role, text. The kinds are "delta" (appends to the turn),
"edit" (sets the turn's text) and "regenerate" (drops the turn's text and all later turns as they were until then).
Logs are dealt by conversation and sorted by seq; a running maximum tells what a regeneration has dropped, and what
is left of each turn is joined to its final message. One shuffle serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<turn role=", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    """Without "<", ">" and bare "&" a text can't hold a marker; unescape() gives it back."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of event logs.

    A turn's role is the last one named. Events of equal seq are taken in order of kind, role and text; a null seq
    comes first, a null text adds nothing, a null kind counts as delta. Other columns are ignored.
    """
    log = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    until = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(until)).where("cut is null or seq >= cut")
    turns = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("edited"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"),
    )
    alive = F.filter("events", lambda e: (e["kind"] != "regenerate") & (F.col("edited").isNull() | (e["seq"] >= F.col("edited"))))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(alive, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans: (start, end) by code points of each assistant text in formatted, as escaped."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BREAK))
    body = escape(F.col("text"))
    made = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("learned"), head.alias("head"), body.alias("body"))
    made = made.select("conv_id", "turn", "learned", F.concat("head", "body", F.lit(CLOSE)).alias("shown"), F.char_length("head").alias("before"), F.char_length("body").alias("own"))
    until = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("shown").cast("long")
    made = made.withColumn("start", F.sum(size).over(until) - size + F.col("before"))
    turns = F.array_sort(F.collect_list(F.struct("start", "shown", "learned", "own")))
    done = made.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["own"]).alias("end")))
    return done.select("conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss_spans"))


def digest(rendered: DataFrame) -> DataFrame:
    """What formatted and loss_spans say when read back: counts and digests of turns and of the text under the loss mask."""
    role = lambda t: F.substr(F.substring_index(t, BREAK, 1), F.lit(len(OPEN) + 1))
    text = lambda t: F.substr(t, F.char_length(F.substring_index(t, BREAK, 1)) + F.lit(len(BREAK) + 1))
    parts = F.split("formatted", CLOSE)
    back = rendered.select("conv_id", "formatted", "loss_spans", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    turns = F.array_join(F.transform("parts", lambda t: F.concat(unescape(role(t)), F.lit("\n"), unescape(text(t)), F.lit("\n"))), "")
    back = back.select("conv_id", F.size("parts").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """The event log of conversations that have one row a turn.

    A text is streamed in two halves; an assistant's reply is drafted and regenerated first. Rows of the same turn are
    turns of their own, in order of role and text; a null turn comes first, a null text is empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    event = lambda k, kind, text: F.struct((F.col("turn") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = [event(2, "delta", F.substr(F.col("text"), F.lit(1), half)), event(3, "delta", F.substr(F.col("text"), half + 1))]
    drafted = [event(0, "delta", F.lit("...")), event(1, "regenerate", F.lit(""))]
    log = F.when(F.col("role") == "assistant", F.array(*drafted, *streamed)).otherwise(F.array(*streamed))
    return rows.select("conv_id", "turn", "role", F.inline(log))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formats conversations of one row a turn and reads the output back; see fold(), render() and digest().

    One row a conversation, a null conv_id being one; an empty table gives an empty result.
    """
    return digest(render(fold(as_events(conversations))))

"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row for each event of a conversation: ``start`` (a message of some role begins), ``delta`` (text streamed onto it), ``edit`` (its
text is replaced) and ``regenerate`` (its text is dropped; later deltas stream a new one). Events are partitioned by conversation and message,
sorted by sequence, and folded: a message's text is what its last edit or regeneration left, and all deltas after that. Messages are then put
in the order in which they started, and rendered.

The template writes a turn as ``### <role>: <text></turn>`` and a line feed. Inside roles and texts a backslash becomes ``\\b``, ``###``
becomes ``\\h``, ``</turn>`` becomes ``\\t`` and, in roles, a colon ``\\c``; every backslash that remains starts one of these, so the way back is
exact. ``loss_spans`` are the code-point ranges of assistant texts in the formatted string. ``read_back`` takes the formatted string and
the spans apart again.

Defined cases: null role or text is empty; deltas before any start belong to a message without role, at its first event; equal sequence
numbers are ordered by kind and text; a null conversation id is a conversation (one conversation is one row of the result, so its log meets in one task); a conversation without messages has no row; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
_ESCAPES = (("\\", "\\b"), ("###", "\\h"), (END, "\\t"))


def escape(c: Column, role: bool = False) -> Column:
    for plain, safe in (*_ESCAPES, *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in ((":", "\\c"), *reversed(_ESCAPES)):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def as_events(conversations: DataFrame) -> DataFrame:
    """A log of finished turns: each row of (conv_id, turn, role, text) starts a message and streams its text. Order: turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *filled).select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    event = lambda k, kind, role, text: F.struct((F.col("message") * 2 + k).alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    events = F.array(event(0, "start", F.col("role"), F.lit("")), event(1, "delta", F.lit(None), F.col("text")))
    return rows.select("conv_id", "message", F.inline(events))


def as_stream(conversations: DataFrame) -> DataFrame:
    """The log that such rows might have come from: each message is begun and a draft streamed, which is then edited or generated anew, in two deltas or one.

    Its fold gives the rows back. Order: turn, role, text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *filled).select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    half, edited = (F.length("text") / 2).cast("int"), F.col("message") % 2 == 0
    first, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    draft = F.concat(F.lit("a draft of "), "role")
    log = [
        (F.lit("start"), F.col("role"), F.lit("")), (F.lit("delta"), F.lit(None), draft), (F.when(edited, "edit").otherwise("regenerate"), F.lit(None), F.when(edited, first).otherwise("")),
        (F.lit("delta"), F.lit(None), F.when(edited, rest).otherwise(first)), (F.lit("delta"), F.lit(None), F.when(edited, "").otherwise(rest)),
    ]
    event = lambda k, kind, role, said: F.struct((F.col("message") * 8 + k).alias("seq"), kind.alias("kind"), role.cast("string").alias("role"), said.cast("string").alias("text"))
    return rows.select("conv_id", "message", F.inline(F.array(*[event(k, *e) for k, e in enumerate(log)])))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, at (sequence of its start), role, text: the final messages of a log of (conv_id, message, seq, kind, role, text)."""
    own = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e.kind.isin("start", "edit", "regenerate"), i).otherwise(F.lit(-1)))
    own = own.withColumn("from", F.array_max(resets))
    kept = F.filter("log", lambda e, i: (i >= F.col("from")) & (e.kind != "regenerate"))
    roles = F.filter("log", lambda e: (e.kind == "start") & e.role.isNotNull())
    starts = F.filter("log", lambda e: e.kind == "start")
    return own.select(
        "conv_id", "message", F.coalesce(F.get(starts.seq, F.lit(0)), F.get(F.col("log.seq"), F.lit(0))).alias("at"), F.coalesce(F.element_at(F.when(F.size(roles) > 0, roles.role), -1), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: F.coalesce(e.text, F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end of each turn's assistant text, null for other turns)."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turns = messages.select("conv_id", "at", "message", (F.col("role") == "assistant").alias("counts"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("at", "message").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    span = F.when(F.col("counts"), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    turns = turns.select("conv_id", F.struct("at", "message", "piece", span.alias("span")).alias("turn"))
    done = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return done.select("conv_id", F.array_join("turns.piece", "").alias("formatted"), F.col("turns.span").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (role, text) and loss_texts, from the formatted string and its spans alone.

    A loss text is what stands at its span's place; where the span doesn't lie within its turn's piece, it is what of the piece it covers.
    """
    pieces = F.filter(F.split("formatted", END + "\n"), lambda x: x != "")
    zipped = F.zip_with(pieces, "loss_spans", lambda p, s: F.struct(p.alias("piece"), s.alias("span")))
    rows = formatted.select("conv_id", F.length("formatted").cast("long").alias("chars"), F.posexplode(zipped).alias("k", "x")).select("conv_id", "chars", "k", "x.*")
    before = F.sum(F.length("piece") + len(END) + 1).over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("span.start") - F.coalesce(before, F.lit(0))
    first, last = F.greatest(at, F.lit(0)), at + F.col("span.end") - F.col("span.start")
    under = F.substr("piece", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
    turn = F.struct(
        "k", unescape(F.substring_index(F.substr("piece", F.lit(5)), ": ", 1)).alias("role"), unescape(F.substr("piece", F.instr("piece", ": ") + 2)).alias("text"),
        F.when(F.col("span").isNotNull(), unescape(under)).alias("loss"),
    )
    done = rows.select("conv_id", "chars", turn.alias("turn")).groupBy("conv_id").agg(F.max("chars").alias("formatted_chars"), F.array_sort(F.collect_list("turn")).alias("got"))
    turns = F.transform("got", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return done.select("conv_id", "formatted_chars", turns.alias("turns"), F.filter(F.col("got.loss"), lambda x: x.isNotNull()).alias("loss_texts"))


def digests(read: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(all_turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), "formatted_chars",
    )

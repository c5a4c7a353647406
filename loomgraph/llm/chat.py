r"""Chat formatting from event logs.

A log has events ``(conversation, sequence, turn, kind, role, text)``:

* ``message``  opens a turn with a role and a text;
* ``delta``    appends text to the turn (streaming);
* ``edit``     replaces the turn's text so far;
* ``regenerate`` empties the turn, whose deltas then start again.

Logs are partitioned by conversation and sorted by sequence; each turn is folded into
its final message; messages are rendered turn by turn and put together.  A hot
conversation is folded and put together in bounded pieces (by turn, then by groups of
``GROUP`` turns), so a task never holds its events, only its rendered text at the end.

Template: ``<|:role|>text<|.|>`` for each turn.  In texts and roles ``\`` is written
``\\`` and ``<|`` is written ``<\|`` (in roles also ``|>`` as ``|\>``), so ``<|`` stands
nowhere but in the template's own marks, and parsing gives roles and texts back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GROUP = 256
ESC, OPEN, CLOSE = "\\", "<|", "|>"
HEAD, END = "<|:", "<|.|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), F.lit(OPEN), F.lit("<" + ESC + "|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: escapes of ``<|`` stand between ``<`` and ``|``, all others are pairs."""
    return F.replace(F.replace(text, F.lit("<" + ESC + "|"), F.lit(OPEN)), F.lit(ESC * 2), F.lit(ESC))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(CLOSE), F.lit("|" + ESC + ">"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("|" + ESC + ">"), F.lit(CLOSE)))


def fold_events(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)``: the final message of each turn that has any event.

    Per turn, only what follows the last message, edit or regenerate counts: that
    event's text (none for regenerate), then the deltas in order of ``seq``.  The role
    is the last one that an event names.  Null texts are empty, null kinds messages;
    null roles stay null; null ``seq`` come first.  A delta with the ``seq`` of a
    message, edit or regenerate comes before it; other ties go by kind and text.  A
    repeated delta row is two deltas, a repeated message one.  Empty turns keep their
    place.  An empty log gives no rows.
    """
    e = events.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(seq).alias("s"), F.coalesce(F.col(kind), F.lit("message")).alias("k"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")
    )
    resets = F.col("k") != "delta"
    order = F.struct("s", "k", "x")
    last = e.groupBy("c", "t").agg(
        F.max(F.when(resets, order)).alias("reset"),
        F.max_by("r", F.when(F.col("r").isNotNull(), order)).alias("role"),
    )
    last = last.select(F.col("c").alias("c_"), F.col("t").alias("t_"), "reset", "role")
    deltas = e.join(last, F.col("c").eqNullSafe(F.col("c_")) & F.col("t").eqNullSafe(F.col("t_"))).where(~resets & (F.col("reset").isNull() | (F.col("s") > F.col("reset.s")) | (F.col("reset.s").isNull() & F.col("s").isNotNull())))
    tail = deltas.groupBy("c", "t").agg(F.sort_array(F.collect_list(F.struct("s", "x"))).alias("d"))
    tail = tail.select(F.col("c").alias("dc"), F.col("t").alias("dt"), F.array_join(F.transform("d", lambda d: d["x"]), "").alias("tail"))
    head = F.when(F.col("reset.k") == "regenerate", F.lit("")).otherwise(F.coalesce(F.col("reset.x"), F.lit("")))
    out = last.join(tail, F.col("c_").eqNullSafe(F.col("dc")) & F.col("t_").eqNullSafe(F.col("dt")), "left")
    return out.select(F.col("c_").alias(conv), F.col("t_").alias(turn), "role", F.concat(head, F.coalesce(F.col("tail"), F.lit(""))).alias("text"))


SPANS = "array<struct<start:int,length:int>>"


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """``(conv, piece, n_turns, formatted, mask)``: the rendered conversation in pieces of ``GROUP`` turn numbers.

    A conversation is its pieces in order, put together (``whole``).  ``mask`` is
    ``array<struct<start, length>>`` in code points of the piece: the (escaped) texts of
    ``trained`` turns, in order.  Turns go by ``turn`` (null first), equal turns by role
    and text.  Null texts and roles are empty.  Null conversations are one conversation.
    """
    r, x = F.coalesce(F.col(role), F.lit("")), escape(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(HEAD), escape_role(r), F.lit(CLOSE))
    one = messages.select(
        F.col(conv).alias("c"), F.floor(F.coalesce(F.col(turn), F.lit(-1)) / GROUP).alias("g"),
        F.struct(F.col(turn).alias("t"), r.alias("r"), F.concat(head, x, F.lit(END)).alias("f"), F.length(head).alias("skip"), F.when(r == trained, F.length(x)).alias("n")).alias("m"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("mask"))

    def step(a: Column, p: Column) -> Column:
        own = F.when(p["n"].isNull(), F.array().cast(SPANS)).otherwise(F.array(F.struct((a["at"] + p["skip"]).alias("start"), p["n"].alias("length"))))
        return F.struct((a["at"] + F.length(p["f"])).alias("at"), F.concat(a["mask"], own).alias("mask"))

    pieces = one.groupBy("c", "g").agg(F.sort_array(F.collect_list("m")).alias("p"))
    return pieces.select(
        F.col("c").alias(conv), F.col("g").alias("piece"), F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda p: p["f"]), "").alias("formatted"), F.aggregate("p", start, step, lambda a: a["mask"]).alias("mask"),
    )


def whole(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, n_turns, formatted)``: pieces put together, a row per conversation."""
    put = pieces.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("piece", "formatted"))).alias("p"), F.sum("n_turns").alias("n_turns"))
    return put.select(conv, "n_turns", F.array_join(F.transform("p", lambda p: p["formatted"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from rendered text."""
    parts = F.split(formatted, "\\Q" + END + "\\E", -1)

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), CLOSE, 1)
        text = F.substr(x, F.length(role) + F.lit(len(HEAD) + len(CLOSE) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under a mask, in order, unescaped."""
    return F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def event_log(rows: DataFrame) -> DataFrame:
    """An event log whose folding gives back ``rows(conv_id, turn, role, text)``, ``turn`` with the row's own mark.

    Each row becomes a turn: a message with a draft, a streamed delta, and then for
    assistants a regeneration and two deltas, for others an edit and a delta; equal rows
    are counted and become a turn each (a null text is an empty one).  So only the fold's
    order of events and its resets lead to the final text.
    """
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("x"))
    alike = rows.groupBy("conv_id", "turn", "role", "x").agg(F.count(F.lit(1)).alias("n"))
    each = alike.select("conv_id", "turn", "role", "x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    half = F.floor(F.length("x") / 2).cast("int")
    head, tail = F.substr("x", F.lit(1), half), F.substr("x", half + 1)
    event = lambda k, kind, role, text: F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    draft = [event(0, "message", F.col("role"), F.concat(F.lit("draft "), tail)), event(1, "delta", none, head)]
    again = [event(2, "regenerate", none, none), event(3, "delta", none, head), event(4, "delta", none, tail)]
    mended = [event(2, "edit", none, head), event(3, "delta", none, tail)]
    events = F.explode(F.when(F.col("role") == "assistant", F.array(*draft, *again)).otherwise(F.array(*draft, *mended)))
    slot = F.struct("turn", F.col("role").alias("of"), F.sha2("x", 256).alias("mark"), "copy")
    return each.select("conv_id", slot.alias("turn"), events.alias("e")).select("conv_id", "turn", "e.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(render(fold_events(event_log(rows.unionByName(extra))).withColumn("turn", F.col("turn.turn"))))


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from rendered pieces, a row per conversation: roles, texts and trained texts as digests."""
    said = pieces.select(
        "conv_id", "piece", F.length("formatted").cast("long").alias("chars"), parse(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("mask")), "").alias("loss")
    ).select(
        "conv_id", F.struct("piece", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"), "loss").alias("s"), F.size("turns").alias("n"), "chars"
    )
    put = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    text, loss = F.array_join(F.transform("s", lambda s: s["t"]), ""), F.array_join(F.transform("s", lambda s: s["loss"]), "")
    return put.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

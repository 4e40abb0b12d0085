"""Chat logs to training texts: events folded into final messages, rendered with a loss mask, and read back; DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import cut, text_or_empty

#: Kinds of events: a message opens, a piece of it arrives, its text is replaced, its text is generated anew.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
#: Turns of a conversation that one row of the output holds at most; a longer one has more rows.
PART_TURNS = 64
#: Sequence numbers of a conversation that are ordered in one task.
SPAN = 1024
#: Code points of a streamed piece.
PIECE = 256
_FIRST = -(1 << 63)


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``open role close text end``; these and the ``also`` strings never stand in a role or text as they are.

    Backslashes in texts are doubled and ``\\e`` is put after the first character of each control string, which one pass from left to right undoes.
    """

    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    also: tuple[str, ...] = ("<s>",)
    #: The role whose texts are learnt.
    learnt: str = "assistant"

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or "\\" in a or any(a[-k:] == b[:k] for b in self.controls for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} is no control string: it is too short, holds a backslash or ends as another begins")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close, self.end, *self.also)

    def escape(self, text: Column) -> Column:
        found = "|".join(map(_quoted, self.controls))
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?={found})(.)", r"$1\\e")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?:(\\)|e)", "$1")


#: Another template in wide use.
IM_TEMPLATE = ChatTemplate("<|im_start|>", "<|im_sep|>", "<|im_end|>", ())


def _quoted(control: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", control)


def turn_events(rows: DataFrame, learnt: str = "assistant") -> DataFrame:
    """Rows of finished turns (conv_id, turn, role, text) as the log that a client keeps while it streams them.

    A turn of the learnt role opens empty, breaks off after its first piece, is generated anew, and comes in pieces of PIECE code points;
    any other turn is one event. Rows of one turn are told apart by a digest of role and text, and exact repeats by a number; a turn's
    ties are in the order of those.
    """
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("seq"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    kept = kept.groupBy("conv_id", "seq", "role", "text").count()
    digest = F.sha2(F.concat("role", F.lit("\n"), "text"), 256)
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    kept = kept.withColumn("message", F.concat_ws("-", F.coalesce(F.col("seq").cast("string"), F.lit("")), digest, F.lpad(F.col("copy").cast("string"), 10, "0")))

    def event(kind: str, part: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.cast("int").alias("part"), text.alias("text"))

    pieces, none = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), F.lit("")
    streamed = F.concat(
        F.array(event(MESSAGE, F.lit(0), none), event(DELTA, F.lit(1), F.coalesce(F.get(pieces, F.lit(0)), none)), event(REGENERATE, F.lit(2), none)),
        F.transform(pieces, lambda t, i: event(DELTA, i + 3, t)),
    )
    whole = F.array(event(MESSAGE, F.lit(0), F.col("text")))
    events = F.when(F.col("role") == learnt, streamed).otherwise(whole)
    return kept.withColumn("event", F.explode(events)).select("conv_id", "seq", "event.part", "event.kind", "message", "role", "event.text")


def _numbered(heads: DataFrame) -> DataFrame:
    """Turn numbers (from 1) of the messages that stay; heads has c, message, position, undone.

    A conversation is ordered in spans of SPAN sequence numbers, and one row a span goes through the whole conversation's order.
    """
    heads = cut(heads.withColumn("span", F.call_function("div", F.col("position.seq"), F.lit(SPAN))))
    within = Window.partitionBy("c", "span").orderBy("position", "message")
    spans = Window.partitionBy("c").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.groupBy("c", "span").agg(F.max("undone").alias("last")).select("c", "span", F.max("last").over(spans).alias("earlier"))
    near = F.max("undone").over(within.rowsBetween(Window.unboundedPreceding, -1))
    # what opened at one place has the same events before it
    peers = Window.partitionBy("c", "span", "position").orderBy("message")
    staying = heads.withColumn("near", near).withColumn("near", F.first("near").over(peers)).join(before, ["c", "span"])
    staying = cut(staying.where(~F.coalesce(F.greatest("near", "earlier") > F.col("position"), F.lit(False))).select("c", "message", "span", "position"))
    counts = staying.groupBy("c", "span").count().select("c", "span", F.coalesce(F.sum("count").over(spans), F.lit(0)).alias("base"))
    return staying.withColumn("n", F.row_number().over(within)).join(counts, ["c", "span"]).select("c", "message", (F.col("base") + F.col("n")).alias("turn"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages of a log of conv_id, seq, part, kind, message, role, text: conv_id, turn (from 1), role, text.

    Events of a conversation are in the order of seq, then part. A message's text is that of its last ``message``, ``edit`` or
    ``regenerate`` event and of all ``delta`` events since; its role is the first one given, its place that of its first event. An edit or a regeneration goes
    back to its message: all messages that opened after that one and before the event are gone, and what still arrives for them is ignored.

    The fold is by conversation and message, so a conversation is spread over as many tasks as it has messages.
    Nulls: a null conv_id is a conversation of its own, a null seq is before all others, a null part is 0, a null text or role is empty; events without a message, or
    of another kind, are left out. Messages that open at once are in the order of their ids; events of one message that come at once, by text.
    Other columns are left out. An empty log gives no rows. Not lazy: the order is checkpointed.
    """
    conv = F.col("conv_id")
    events = log.select(
        conv,
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("c"),
        F.struct(F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST)).alias("seq"), F.coalesce(F.col("part").cast("int"), F.lit(0)).alias("part")).alias("at"),
        "kind",
        F.col("message").cast("string").alias("message"),
        F.col("role").cast("string").alias("role"),
        text_or_empty("text").alias("text"),
    ).where(F.col("message").isNotNull() & F.col("kind").isin(MESSAGE, DELTA, EDIT, REGENERATE))
    undone = F.max(F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("at")))
    turns = _numbered(events.groupBy("c", "message").agg(F.min("at").alias("position"), undone.alias("undone")))
    begun = F.max(F.when(F.col("kind") != DELTA, F.col("at"))).over(Window.partitionBy("c", "message"))
    piece = F.when(F.coalesce(F.col("at") >= F.col("begun"), F.lit(True)), F.struct("at", "text"))
    folded = events.withColumn("begun", begun).groupBy("c", "message").agg(
        F.first("conv_id").alias("conv_id"),  # one value
        F.coalesce(F.min(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
    )
    return folded.join(turns, ["c", "message"]).select("conv_id", "turn", "role", "text")


def render(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Training texts of conv_id, turn, role, text: conv_id, part (from 0), formatted, loss_spans.

    A conversation's text is that of its parts in order; a part has at most PART_TURNS turns, so no conversation is gathered whole. ``loss_spans`` are the ranges of code points
    of a part (start, end) that are learnt: the texts of the learnt role, in order.
    """
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.close))
    body = template.escape(F.col("text"))
    pieces = turns.select(
        "conv_id",
        F.call_function("div", F.col("turn") - 1, F.lit(PART_TURNS)).alias("part"),
        F.struct("turn", F.concat(head, body, F.lit(template.end)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == template.learnt).alias("learnt")).alias("t"),
    )
    gathered = pieces.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    sizes = F.transform("ts", lambda t: F.length(t["piece"]))

    def span(t, i):
        start = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b) + t["head"]
        return F.struct(start.alias("start"), (start + t["body"]).alias("end"), t["learnt"].alias("learnt"))

    spans = F.transform(F.filter(F.transform("ts", span), lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return gathered.select("conv_id", "part", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_rendered(rendered: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What ``render`` wrote, taken apart: conv_id, part, turns (array of role, text), loss_text (all learnt texts joined), formatted_chars."""
    ended = F.split("formatted", _quoted(template.end), -1)
    turns = F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), lambda p: F.split(p, _quoted(template.close), 2))
    turns = F.transform(
        turns, lambda p: F.struct(template.unescape(F.substr(F.get(p, F.lit(0)), F.lit(len(template.open) + 1))).alias("role"), template.unescape(F.get(p, F.lit(1))).alias("text"))
    )
    loss = F.transform("loss_spans", lambda s: template.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return rendered.select("conv_id", "part", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def write_chats(log: DataFrame, path: str, template: ChatTemplate = ChatTemplate()) -> None:
    """Fold a log and write its training texts as Parquet."""
    render(fold_events(log), template).write.parquet(path)


def read_chats(spark: SparkSession, path: str, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    return read_rendered(spark.read.parquet(path), template)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation of ``read_chats``: n_turns, and counts and digests of its transcript and learnt text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.select("conv_id", "part", F.size("turns").alias("n"), said.alias("said"), "loss_text", "formatted_chars")
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "said", "loss_text"))).alias("parts"), F.sum(F.length("loss_text")).alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars")
    )
    joined = [F.sha2(F.array_join(whole["parts"][name], ""), 256) for name in ("said", "loss_text")]
    return whole.select("conv_id", "n_turns", joined[0].alias("turns_sha256"), "loss_chars", joined[1].alias("loss_sha256"), "formatted_chars")

"""Chat samples from an event log: messages are folded from their events, then rendered and masked.

A log row is one event of one message: ``conv_id``, ``seq`` (any orderable type, the order inside
the conversation), ``kind``, ``turn`` (the place of the message), ``message`` (its identity; several
messages may claim one turn), ``role`` (of an ``open`` event), ``text``. Kinds:

* ``open`` begins a message, ``delta`` appends its text,
* ``edit`` replaces all that the message says so far,
* ``regenerate`` empties the message, and removes the messages of later turns that were opened
  before it, which answered what is now gone.

``fold`` gives the messages that remain, ``samples`` one rendered text per conversation with the
runs of its loss mask, ``read_samples`` the turns and the text under the mask again.

A log row delivered twice counts once. Events of one message with equal ``seq`` apply in the
order of their texts. A null text is empty, a null role is the empty role, a message without
``open`` or turn stays (role empty, before all turns). Rows without ``conv_id`` are one
conversation. Messages of one turn are ordered by role, text and identity. Further columns are
not read; an empty log gives no samples.

Events are combined by message; what regenerations remove is decided on rows without text, by
a running maximum in two steps, so a conversation with very many messages is no single task
there. A sample is one value, so only the last step brings a conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other templates: a first sign and a rest that holds no such sign,
#: so two of them never overlap. Backslashes between both mark an escaped one.
FIRST, REST = r"(<|\[)", r"(/?s>|/?SYS>|/?INST\]|\|[a-z_]+\|>)"
PLAIN, ESCAPED = FIRST + r"(\\*)" + REST, FIRST + r"\\(\\*)" + REST
#: Turns of a conversation whose running maximum is one window.
TURNS = 4096
_NO_TURN = -(1 << 62)


def escaped(text: Column) -> Column:
    """One more backslash inside everything that is, or could be unescaped to, a control string."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def removed_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message of those opened before a regeneration of an earlier turn."""
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    opened = F.min(F.when(F.col("kind") == "open", F.col("seq")))
    slim = (events.where(F.col("kind").isin("open", "regenerate")).groupBy("conv_id", "turn", "message")
            .agg(opened.alias("opened"), regenerated.alias("regenerated"))
            .withColumn("_turn", F.greatest(F.col("turn"), F.lit(_NO_TURN)))
            .withColumn("_part", F.expr(f"_turn div {TURNS}")))
    earlier_parts = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (slim.groupBy("conv_id", "_part").agg(F.max("regenerated").alias("_most"))
             .select("conv_id", "_part", F.max("_most").over(earlier_parts).alias("_before")))
    # Turns of one part lie close together, so a range of turn numbers is safe from overflow.
    earlier = Window.partitionBy("conv_id", "_part").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    same = parts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), "_before")
    return (slim.withColumn("_inside", F.max("regenerated").over(earlier))
            .join(same, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_of")))
            .where("opened < greatest(_before, _inside)").select("conv_id", "turn", "message"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text of every message that remains."""
    columns = ("conv_id", "seq", "kind", "turn", "message", "role", "text")
    events = events.withColumn("turn", F.col("turn").cast("long")).select(*columns)
    # What is removed comes as one more event of the message, so texts move once.
    gone = removed_messages(events).withColumn("kind", F.lit("removed"))
    resets = F.col("kind").isin("open", "edit", "regenerate")
    said = (events.unionByName(gone, allowMissingColumns=True).groupBy("conv_id", "turn", "message").agg(
        F.max(F.col("kind") == "removed").alias("removed"),
        F.min(F.when((F.col("kind") == "open") & F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.collect_set(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))).alias("parts")))
    standing = F.filter("parts", lambda p: F.coalesce(p["seq"] >= F.col("reset"), F.lit(True)))
    return said.where("NOT removed").select(
        "conv_id", "turn", "message", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(standing), lambda p: p["text"]), "").alias("text"))


def samples(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_runs: one text per conversation.

    ``loss_runs`` has four lengths per turn, in code points: outside the mask, under it, and
    both again for what closes the turn. Only texts of the role ``learned`` lie under it.
    """
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    outside = F.lit(len(BEGIN + MIDDLE)) + F.length(role)
    learns = F.col("role") == learned
    size = F.length(text)
    runs = F.array(outside, F.when(learns, size).otherwise(0), F.when(learns, 0).otherwise(size) + F.lit(len(END)), F.lit(0))
    turn = F.struct(F.coalesce("turn", F.lit(_NO_TURN)).alias("turn"), role.alias("role"), text.alias("text"), "message", runs.alias("runs"))
    gathered = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END)))
    return gathered.select("conv_id", F.array_join(piece, "").alias("formatted"),
                           F.flatten(F.col("turns")["runs"]).alias("loss_runs"))


def read_samples(rendered: DataFrame) -> DataFrame:
    """conv_id, n_chars, turns (role, text) and learned (texts under the mask, in order), from rendered samples alone."""
    pieces = F.slice(F.split("formatted", BEGIN.replace("|", r"\|")), 2, 1 << 30)
    cut = rendered.withColumn("_pieces", F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(pieces))
    body = lambda p: F.substring_index(F.substring_index(p, MIDDLE, -1), END, 1)
    under = F.transform("_pieces", lambda p, i: F.struct(
        F.col("loss_runs")[i * 4 + 1].alias("size"),
        F.substring(p, F.col("loss_runs")[i * 4] - len(BEGIN) + 1, F.col("loss_runs")[i * 4 + 1]).alias("text")))
    return cut.select(
        "conv_id", F.length("formatted").cast("long").alias("n_chars"),
        F.transform("_pieces", lambda p: F.struct(unescaped(F.substring_index(p, MIDDLE, 1)).alias("role"),
                                                  unescaped(body(p)).alias("text"))).alias("turns"),
        F.transform(F.filter(under, lambda s: s["size"] > 0), lambda s: unescaped(s["text"])).alias("learned"))


#: Code points of one streamed delta of ``log_of``.
DELTA = 512


def log_of(rows: DataFrame) -> DataFrame:
    """An event log whose fold is ``rows`` (conv_id, turn, role, text), with all that a log may hold.

    Assistant texts stream as deltas after a first draft, which was answered and then
    regenerated. Other texts are typed wrongly first and then edited.
    """
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"),
                        F.monotonically_increasing_id().alias("message"))
    event = lambda step, kind, text, turn=None, message=None, role=None: F.struct(
        F.struct("turn", F.lit(step).alias("step")).alias("seq"), F.lit(kind).alias("kind"),
        (F.col("turn") if turn is None else turn).alias("turn"), (F.col("message") if message is None else message).alias("message"),
        (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    empty, draft = F.lit(""), F.reverse(F.substring("text", 1, 12))
    opened = event(0, "open", empty, role=F.col("role"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), 0), lambda part, i: F.struct(
        F.struct("turn", (i + 4).alias("step")).alias("seq"), F.lit("delta").alias("kind"), F.col("turn").alias("turn"),
        F.col("message").alias("message"), F.lit(None).cast("string").alias("role"), part.alias("text")))
    answer = event(2, "open", draft, turn=F.try_add("turn", F.lit(1)), message=-1 - F.col("message"), role=F.lit("user"))
    streamed = F.concat(F.array(opened, event(1, "delta", draft), answer, event(3, "regenerate", F.lit(None).cast("string"))), deltas)
    typed = F.array(opened, event(1, "delta", draft), event(2, "edit", F.col("text")))
    return (keyed.select("conv_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("event"))
            .select("conv_id", "event.*"))


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from its sample: turns, and what lies under the loss mask, as digests."""
    learned = F.array_join("learned", "")
    turn_lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_samples(rendered).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turn_lines, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.col("n_chars").alias("formatted_chars"))

"""Chat formatting: messages reconstructed from an event log, then rendered, in DataFrame operations only.

An event has a conversation, a sequence number, a turn, a kind, a role and a text. Kinds: `message` opens a message, `delta` adds to
the message that its turn opened last, `edit` replaces that message's text, and `regenerate` does the same and also
withdraws all messages of later turns that had begun by then. Events come in any order. They fold by (conversation, turn), and turns meet in blocks of
TURNS, which render them; the latest regeneration before a turn is a running maximum within its block and one over the blocks before. So a
long conversation is folded and rendered in many tasks, and only block strings meet per conversation.

The template is "### role:\\ntext</turn>\\n" for each turn. In texts and roles, backslash, "###" and "</turn>" (in roles also the line
feed) become backslash codes, so no text can pose as a marker and every text can be read back exactly. The loss mask comes with the string: the
spans of the assistant's texts, in characters.

Null texts are empty, null roles are empty roles, null conversations form one conversation, null turns come first. Sequence numbers are of any type that
has an order. Rows that tie in turn and sequence are ordered by role and text, and repeated message rows stay separate messages. Kinds are matched exactly; an event of another
kind, or one that continues a message that was never opened, opens a message of its own. A very long conversation is one row of the output, as it must be, and is put
together from its blocks. Other columns of the events are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BITS = 6
TURNS = 1 << BITS
HEAD, END = "### ", "</turn>\n"
_CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(text: Column) -> Column:
    for plain, code in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


_KEYS = ("nil", "conv")  # of a conversation; neither is null


def _placed(df: DataFrame) -> DataFrame:
    """df with the keys of its conversation, and the block of its turn and the place there; the null turn has a block of its own."""
    turn = F.col("turn").cast("long")
    return df.select(
        F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "*",
        F.coalesce(F.shiftright(turn, BITS), F.lit(-(1 << 62))).cast("long").alias("block"), F.coalesce(turn.bitwiseAND(F.lit(TURNS - 1)), F.lit(0)).cast("int").alias("place"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role and text of each final message. events: conv_id, seq, turn, kind, role, text."""
    e = _placed(events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    again = F.when(F.col("kind") == "regenerate", F.col("seq"))
    # the latest regeneration in the blocks before each block: rows without texts
    blocks = e.groupBy(*_KEYS, "block").agg(F.max(again).alias("again"))
    before = F.max("again").over(Window.partitionBy(*_KEYS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*_KEYS, "block", before.alias("before"))
    by_turn, order = Window.partitionBy(*_KEYS, "turn"), ("seq", "role", "text")
    running = by_turn.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.coalesce(F.col("kind").isin("delta", "edit", "regenerate"), F.lit(False))
    e = e.withColumn("again", F.max(again).over(by_turn))
    e = e.withColumn("message", F.sum(F.when(goes_on, 0).otherwise(1)).over(running)).withColumn("i", F.row_number().over(by_turn.orderBy(*order)))
    e = e.withColumn("reset", F.max(F.when(~goes_on | F.col("kind").isin("edit", "regenerate"), F.col("i"))).over(running))
    parts = e.groupBy(*_KEYS, "turn", "message").agg(
        F.first("conv_id").alias("conv_id"), F.first("block").alias("block"), F.first("place").alias("place"), F.first("again").alias("again"), F.max("reset").alias("start"),
        F.array_sort(F.collect_list(F.struct("i", "seq", "role", "text"))).alias("parts"),
    )
    kept = F.filter("parts", lambda p: p["i"] >= F.coalesce(F.col("start"), F.lit(0)))
    first = F.get("parts", F.lit(0))  # a message belongs to its first event's role, wherever its text begins
    folded = parts.select(*_KEYS, "conv_id", "block", "place", "turn", "message", "again", first["role"].alias("role"), F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"), first["seq"].alias("began"))
    joined = folded.join(blocks, [*_KEYS, "block"])
    earlier = F.max("again").over(Window.partitionBy(*_KEYS, "block").orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    late = lambda c: F.coalesce(F.col(c) > F.col("began"), F.lit(False))
    return joined.withColumn("earlier", earlier).filter(~late("before") & ~late("earlier")).select("conv_id", "turn", "message", "role", "text")


def render_blocks(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """The keys of a conversation, conv_id, block, piece (the block's string) and spans (start and end there of each text of the learned role, in characters from 0)."""
    role, text = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), escape(F.col("text"))
    head = F.concat(F.lit(HEAD), role, F.lit(":\n"))
    rows = _placed(messages).select("conv_id", *_KEYS, "block", "place", "message", (F.col("role") == learned).alias("learned"), F.length(head).alias("from"), F.length(text).alias("chars"), F.concat(head, text, F.lit(END)).alias("piece"))
    ordered = Window.partitionBy(*_KEYS, "block").orderBy("place", "message")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) + F.col("from"))
    items = F.sort_array(F.collect_list(F.struct("place", "message", "piece", "learned", "at", "chars")))
    blocks = rows.groupBy(*_KEYS, "block").agg(F.first("conv_id").alias("conv_id"), items.alias("items"))
    span = lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["chars"]).alias("end"))
    return blocks.select(*_KEYS, "conv_id", "block", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("piece"), F.transform(F.filter("items", lambda x: x["learned"]), span).alias("spans"))


def join_blocks(blocks: DataFrame, *also: str) -> DataFrame:
    """conv_id, formatted and loss_spans (places in formatted), one row for each conversation; and other strings of the blocks, joined like formatted."""
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(Window.partitionBy(*_KEYS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = blocks.withColumn("before", before)
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("before")).alias("start"), (x["end"] + F.col("before")).alias("end")))
    out = blocks.withColumn("spans", moved).groupBy(*_KEYS).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("block", "piece", "spans", *also))).alias("items"))
    joined = lambda c: F.array_join(F.transform("items", lambda x: x[c]), "")
    return out.select("conv_id", joined("piece").alias("formatted"), F.flatten(F.transform("items", lambda x: x["spans"])).alias("loss_spans"), *(joined(c).alias(c) for c in also))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (start and end, in characters from 0, of each text of the learned role), one row for each conversation."""
    return join_blocks(render_blocks(messages, learned))


def learned_text(piece: Column, spans: Column) -> Column:
    """The texts under the spans, unescaped, one after another. For the strings of blocks: each cut looks at the whole string."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(piece, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of role and text."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        colon = F.locate(":\n", p)
        role = F.substring(p, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(F.substring(p, colon + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """An event log that ends in these conversations, as a service would have written it.

    By a hash of the row, a turn comes as one message; as an empty message and deltas; as a draft and its edit; as deltas and an edit; or as a draft, answered
    by a message that a regeneration of the turn withdraws, and the deltas of that. Sequence numbers are (turn, row of the turn, step). Events are in no order.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    text, n = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    thirds = F.substring(text, F.lit(1), n), F.substring(text, n + 1, n), F.substring(text, 2 * n + 1, F.length("text"))
    kinds = {
        0: (("message", text),),
        1: (("message", F.lit("")), *(("delta", t) for t in thirds)),
        2: (("message", F.concat(thirds[0], F.lit(" (draft)"))), ("edit", text)),
        3: (("message", thirds[2]), ("delta", thirds[0]), ("edit", F.concat(thirds[0], thirds[1])), ("delta", thirds[2])),
        4: (("message", F.concat(F.lit("Draft: "), thirds[1])), ("later", F.lit("An answer to the draft.")), ("regenerate", F.lit("")), *(("delta", t) for t in thirds)),
    }

    def event(step: int, kind: str, body: Column) -> Column:
        turn, name = (F.col("turn") + 1, "message") if kind == "later" else (F.col("turn"), kind)
        return F.struct(F.struct(F.col("turn"), F.col("row"), F.lit(step).alias("step")).alias("seq"), turn.alias("turn"), F.lit(name).alias("kind"), body.alias("text"))

    style = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(5))
    style = F.when((style == 4) & (F.col("turn").isNull() | (F.col("turn") == (1 << 63) - 1)), 1).otherwise(style)
    events = F.array(*(event(step, kind, body) for step, (kind, body) in enumerate(kinds[0])))
    for k in range(1, 5):
        events = F.when(style == k, F.array(*(event(step, kind, body) for step, (kind, body) in enumerate(kinds[k])))).otherwise(events)
    return rows.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.turn", "e.kind", "role", "e.text")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    blocks = render_blocks(reconstruct(conversation_events(rows)))
    out = join_blocks(blocks.withColumn("loss", learned_text(F.col("piece"), F.col("spans"))), "loss").withColumn("turns", parse(F.col("formatted")))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), "loss", F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 2
           + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

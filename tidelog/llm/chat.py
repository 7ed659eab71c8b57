"""Chat formatting: conversations into token-budgeted windows with a loss mask.

Prefix sums of the turns' tokens place every turn: the window of a turn is its start divided by the fresh-token room,
so windows end between turns and no turn depends on how earlier ones were packed. A window repeats the conversation's
system turn and as many of the turns just before it as fit ``history`` tokens; only its own assistant turns carry loss,
so each target counts once. A window stays within ``budget`` as long as its last turn is within ``turn_room`` and the
system turn within ``system_room``; turns are never cut, and longer ones are marked ``over_budget``.

The template's markers are control strings. In texts, every control string gets a backslash behind its first character
(and one more if there are some already), which is undone when reading.

All of it is DataFrame functions. Prefix sums run in chunks of turn numbers, so no task holds a whole conversation.

Nulls and odd cases: null text and null role are empty; roles without markers of their own are written out; null turns
come first; equal turns are ordered by role and text; rows without ``conv_id`` are one conversation; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.base import query, table


@dataclass(frozen=True)
class Template:
    """Markers around the text of a role. Other roles name themselves between ``role`` markers."""

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"),
    )
    role_open: str = "<<ROLE>>"
    role_close: str = "<</ROLE>>"
    turn_close: str = "<</TURN>>"

    @property
    def controls(self) -> list[str]:
        own = [m for _, start, end in self.roles for m in (start, end)]
        return [*own, self.role_open, self.role_close, self.turn_close]

    def _pattern(self, slash: str) -> str:
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in self.controls}, key=len, reverse=True))
        return f"([{firsts}]){slash}(\\\\*)({rests})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "$1$2$3")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.role_open), self.escape(role), F.lit(self.role_close))
        for name, start, _ in self.roles:
            out = F.when(role == name, F.lit(start)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.turn_close)
        for name, _, end in self.roles:
            out = F.when(role == name, F.lit(end)).otherwise(out)
        return out

    def parse(self, text: Column) -> Column:
        """Formatted text back into an array of ``role, text``."""
        ends = "|".join(re.escape(m) for m in [*(end for _, _, end in self.roles), self.turn_close])
        pieces = F.filter(F.split(text, f"(?<={ends})"), lambda p: p != "")

        def turn(piece: Column) -> Column:
            named = "(?s)^" + re.escape(self.role_open) + "(.*?)" + re.escape(self.role_close) + "(.*)" + re.escape(self.turn_close) + "$"
            role, body = F.regexp_extract(piece, named, 1), F.regexp_extract(piece, named, 2)
            for name, start, end in self.roles:
                mine = piece.startswith(start)
                inner = F.substr(piece, F.lit(len(start) + 1), F.length(piece) - len(start) - len(end))
                role, body = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner).otherwise(body)
            return F.struct(self.unescape(role).alias("role"), self.unescape(body).alias("text"))

        return F.transform(pieces, turn)


TEMPLATE = Template()


@dataclass(frozen=True)
class Budget:
    budget: int = 2048
    history: int = 256
    system_room: int = 256
    turn_room: int = 512
    chunk: int = 64

    @property
    def fresh(self) -> int:
        room = self.budget - self.history - self.system_room - self.turn_room
        if room <= self.history:
            raise ValueError("the budget leaves no more room for new turns than for history")
        return room


BUDGET = Budget()


def turn_tokens(text: Column) -> Column:
    """Estimate: a token for four bytes, and four for the markers."""
    return (F.floor((F.octet_length(text) + 3) / 4) + 4).cast("long")


def _turns(conversations: DataFrame, tokens, chunk: int) -> DataFrame:
    """Every turn with its place ``at``, its first token ``start`` and the text of its conversation's system turn."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumn(
        "chunk", F.coalesce(F.expr(f"turn div {chunk}"), F.lit(-(1 << 62)))
    )
    # Division rounds towards zero; a negative turn of its own chunk keeps the order.
    rows = rows.withColumn("chunk", F.when(F.col("turn") < 0, F.col("chunk") - 1).otherwise(F.col("chunk")))
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "until": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.sum("tokens").alias("n_tokens"), F.count("*").alias("n"),
        F.max(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("text"))).alias("system"),
    )
    over = Window.partitionBy("conv_id").orderBy("chunk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("token0"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at0"), F.first("system").over(over).alias("system"),
    )
    met = rows.join(chunks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    return met.select(
        "conv_id", "role", "text", "tokens", "system", (F.col("at0") + F.col("place") - 1).alias("at"),
        (F.col("token0") + F.col("until") - F.col("tokens")).alias("start"),
    )


def format_windows(
    conversations: DataFrame, *, template: Template = TEMPLATE, budget: Budget = BUDGET, tokens=turn_tokens
) -> DataFrame:
    """``conv_id, window, text, n_context, loss, n_tokens, over_budget``: the first ``n_context`` turns of a window are
    repeated; ``loss`` has the spans (``start`` from 0 and ``length``, in characters of ``text``) that carry loss."""
    room, reach = budget.fresh, budget.history
    turns = _turns(conversations, tokens, budget.chunk)
    own = F.expr(f"start div {room}")
    is_system = (F.col("at") == 0) & F.col("system").isNotNull()
    last = F.when(is_system, own).otherwise(F.expr(f"(start + {reach}) div {room}"))
    spread = turns.withColumn("own", own).withColumn("window", F.explode(F.sequence(own, last)))
    turn = F.struct("at", "start", "tokens", "role", "text", (F.col("own") == F.col("window")).alias("fresh"))
    grouped = spread.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("system").alias("system"),
        F.min(F.when(F.col("own") == F.col("window"), F.col("start"))).alias("first"),
    ).filter(F.col("first").isNotNull())
    kept = F.filter("turns", lambda t: t["fresh"] | (F.col("first") - t["start"] <= reach))
    grouped = grouped.withColumn("turns", kept)
    again = F.col("system").isNotNull() & (F.col("turns")[0]["at"] > 0)
    front = F.struct(
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("start"), tokens(F.col("system")).alias("tokens"),
        F.lit("system").alias("role"), F.col("system").alias("text"), F.lit(False).alias("fresh"),
    )
    grouped = grouped.withColumn("turns", F.when(again, F.concat(F.array(front), F.col("turns"))).otherwise(F.col("turns")))

    def piece(t: Column) -> Column:
        return F.struct(
            template.opening(t["role"]).alias("head"), template.escape(t["text"]).alias("body"),
            template.closing(t["role"]).alias("tail"), (t["fresh"] & (t["role"] == "assistant")).alias("loss"),
        )

    pieces = grouped.withColumn("pieces", F.transform("turns", piece))
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, p: Column) -> Column:
        begin, size = acc["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct(
            (begin + size + F.length(p["tail"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    return pieces.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("text"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_context"), spans.alias("loss"),
        total.alias("n_tokens"), (total > budget.budget).alias("over_budget"),
    )


def read_back(windows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of whole conversations from formatted windows alone. The contract's digests need one text per
    conversation, so here, and only here, a conversation meets in one row."""
    turns = template.parse(F.col("text"))
    fresh = F.slice(turns, F.col("n_context") + 1, F.greatest(F.size(turns) - F.col("n_context"), F.lit(0)))
    loss = F.transform("loss", lambda s: template.unescape(F.substr("text", s["start"] + 1, s["length"])))
    rows = windows.select("conv_id", "window", F.length("text").alias("chars"), fresh.alias("fresh"), loss.alias("loss"))
    rows = rows.select(
        "conv_id", "window", "chars", F.size("fresh").alias("n"), F.array_join("loss", "").alias("loss"),
        F.array_join(F.transform("fresh", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, (strlen(text) + 3) // 4 + 4 AS tokens,
    row_number() OVER w - 1 AS pos, coalesce(sum((strlen(text) + 3) // 4 + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
written AS (
  SELECT *, start // 1024 AS own,
    length(regexp_replace(text, '([<\[])(\\*)(</SYS>>|</ROLE>>|</TURN>>|<SYS>>|<ROLE>>|/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
        ELSE 26 + length(regexp_replace(role, '([<\[])(\\*)(</SYS>>|</ROLE>>|</TURN>>|<SYS>>|<ROLE>>|/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g')) END AS chars
  FROM turns),
windows AS (SELECT conv_id, own, min(start) AS w0, sum(chars) AS chars FROM written GROUP BY ALL),
repeated AS (
  SELECT w.conv_id, sum(t.chars) AS chars FROM windows w JOIN written t ON t.conv_id = w.conv_id AND t.own < w.own
  WHERE (t.pos = 0 AND t.role = 'system')
     OR (w.w0 - t.start <= 256 AND (t.start + 256) // 1024 >= w.own AND NOT (t.pos = 0 AND t.role = 'system'))
  GROUP BY ALL)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(written.chars) + coalesce((SELECT r.chars FROM repeated r WHERE r.conv_id = written.conv_id), 0))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op1_chat", SQL)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return read_back(format_windows(given.unionByName(more)))

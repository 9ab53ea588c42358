"""Chat formatting: windows of whole turns within a token budget, with a loss mask.

Prefix sums of the turns' tokens choose the windows, so nothing walks over a conversation: a turn
belongs to the cell of the token axis in which it starts. A cell is half of what the budget leaves
after system turn and history, so a cell's turns with the one that crosses its end fit the budget; a
turn longer than a cell has a window of its own. Each window repeats the system turn and the last turns
before it, up to ``history`` tokens or what a long turn leaves of the budget, and both are masked: each
assistant turn is under the loss mask in exactly one window. As turns are never cut, a window exceeds
the budget only if its one turn and the system turn do, or the system turn alone.

Template of a turn: ``<turn>role<turn:text>text</turn>`` and a line feed; ``<turn:again>`` begins a
repeated one. In roles and texts a backslash goes between ``<`` or ``</`` (and backslashes that
follow) and ``turn``, so a control string never occurs in them, and taking one backslash away there
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactline.llm.common import n_words

NEW, AGAIN, TEXT, END = "<turn>", "<turn:again>", "<turn:text>", "</turn>\n"
#: Turns of a conversation whose tokens are summed by one task.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*+)turn", r"$1\\turn")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*)\\turn", r"$1turn")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _with_starts(turns: DataFrame) -> DataFrame:
    """Adds ``n`` (place of the turn) and ``a`` (tokens before it), by blocks of turn numbers, so
    that a conversation of any length is dealt over many tasks."""
    block = F.floor(F.coalesce("turn", F.lit(0)) / BLOCK)
    turns = turns.withColumn("_block", block)
    before = (
        turns.groupBy("conv_id", "_block")
        .agg(F.sum("tokens").alias("_sum"), F.count("*").alias("_rows"))
    )
    earlier = (
        Window.partitionBy("conv_id").orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    before = before.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_a"),
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_n"),
    )
    order = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.select(
        "*",
        F.row_number().over(order).alias("_i"),
        F.coalesce(F.sum("tokens").over(so_far), zero).alias("_t"),
    )
    return inside.join(
        before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b"))
    ).select(
        "conv_id", "role", "text", "tokens",
        (F.col("_n") + F.col("_i") - 1).alias("n"), (F.col("_a") + F.col("_t")).alias("a"),
    )


def format_chats(
    turns: DataFrame, budget: int = 1024, history: int = 128, overhead: int = 4, tokens=n_words
) -> DataFrame:
    """Windows of conversations: ``conv_id``, ``window`` (in order), ``formatted``, ``loss``
    (array of ``start``, ``length`` in code points of ``formatted``) and ``n_tokens``.

    Input: ``conv_id``, ``turn``, ``role``, ``text``; other columns are left out. ``tokens`` counts
    a text's tokens, ``overhead`` those of the markup. Null roles and texts are empty, turns are
    ordered by turn (null first, with block 0), role and text, repeated rows are turns of their
    own, rows without ``conv_id`` are one conversation, and an empty table gives no windows. The
    first system turn is the retained one. History takes half of what it leaves of the budget at
    most; if it leaves nothing, windows hold ``budget`` tokens next to it. Empty assistant texts have a
    mask of length 0.
    """
    rows = turns.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")) + overhead)
    rows = _with_starts(rows)
    system = (
        rows.where(F.col("role") == "system").groupBy("conv_id")
        .agg(F.min_by(F.struct("n", "role", "text", "tokens"), "n").alias("system"))
        .select(F.col("conv_id").alias("_conv"), "system")
    )
    rows = rows.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    of_system = F.coalesce("system.tokens", F.lit(0))
    room = F.when(of_system < budget, budget - of_system).otherwise(budget).cast("long")
    rows = rows.withColumn("room", room).withColumn(
        "back", F.least(F.lit(history).cast("long"), F.floor(F.col("room") / 2)))
    cell = F.greatest(F.floor((F.col("room") - F.col("back")) / 2), F.lit(1)).cast("long")
    rows = rows.withColumn("cell", cell)
    # Cells are numbered by two: the odd number is the window of a turn longer than the cell.
    at = F.floor(F.col("a") / F.col("cell")) * 2 + (F.col("tokens") > F.col("cell")).cast("long")
    rows = rows.withColumn("window", at.cast("long"))
    left = F.greatest(F.first("room") - F.sum("tokens"), F.lit(0))
    starts = rows.groupBy("conv_id", "window").agg(
        F.min("a").alias("_start"),
        F.when(F.col("window") % 2 == 1, F.least(F.first("back"), left)).otherwise(F.first("back"))
        .alias("_back"),
    ).select(F.col("conv_id").alias("_conv"), F.col("window").alias("_w"), "_start", "_back")
    last = F.floor((F.col("a") + F.col("back")) / F.col("cell")) * 2 + 1
    narrow = rows.select(
        "conv_id", "a", "n", "role", "text", "tokens", "system", F.col("window").alias("own"),
        F.explode(F.sequence(F.col("window"), F.greatest(F.col("window"), last))).alias("window"),
    )
    placed = narrow.join(
        starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("window") == F.col("_w"))
    ).where(
        (F.col("own") == F.col("window"))
        | ((F.col("a") >= F.col("_start") - F.col("_back")) & (F.col("own") < F.col("window")))
    )
    turn = F.struct(
        "n", (F.col("own") == F.col("window")).alias("new"), "role", "text", "tokens")
    windows = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.first("system").alias("system"))
    repeated = F.struct(
        F.col("system.n").alias("n"), F.lit(False).alias("new"), F.col("system.role").alias("role"),
        F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"),
    )
    kept = F.col("system").isNotNull() & ~F.exists("turns", lambda t: t["n"] == F.col("system.n"))
    windows = windows.withColumn(
        "turns", F.when(kept, F.concat(F.array(repeated), F.col("turns"))).otherwise(F.col("turns"))
    )

    def marked(t: Column) -> Column:
        head = F.concat(
            F.when(t["new"], F.lit(NEW)).otherwise(F.lit(AGAIN)), escape(t["role"]), F.lit(TEXT))
        return F.struct(
            head.alias("head"), escape(t["text"]).alias("body"),
            (t["new"] & (t["role"] == "assistant")).alias("loss"),
        )

    windows = windows.withColumn("parts", F.transform("turns", marked))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(begin.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct(
            (begin + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"),
        )

    return windows.select(
        "conv_id", "window",
        F.concat_ws("", F.transform(
            "parts", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("parts", start, step)["loss"].alias("loss"),
        F.aggregate(
            "turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("n_tokens"),
    )


def turns_of(formatted: Column) -> Column:
    """Turns read back from a formatted window, without repeated ones: array of role, text."""

    def turn(p: Column) -> Column:
        at = F.locate(TEXT, p)
        return F.struct(
            unescape(F.substr(p, F.lit(len(NEW) + 1), at - len(NEW) - 1)).alias("role"),
            unescape(F.substr(p, at + len(TEXT))).alias("text"),
        )

    parts = F.filter(F.split(formatted, END, -1), lambda p: p.startswith(NEW))
    return F.transform(parts, turn)


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text and its mask alone."""
    read = windows.select(
        "conv_id", "window", "n_tokens", F.length("formatted").alias("chars"),
        turns_of(F.col("formatted")).alias("turns"),
        F.concat_ws("", F.transform("loss", lambda s: unescape(
            F.substr(F.col("formatted"), s["start"] + 1, s["length"])))).alias("learnt"),
    ).select(
        "*",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("window", "said", "learnt")))
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.count("*").alias("n_windows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        in_order.alias("_all"),
    )
    joined = lambda f: F.concat_ws("", F.transform("_all", lambda w: w[f]))
    return whole.select(
        "conv_id", "n_turns", "n_windows", "n_tokens",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("learnt")).cast("long").alias("loss_chars"),
        F.sha2(joined("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def sql(budget: int = 1024, history: int = 128, overhead: int = 4) -> str:
    """DuckDB SQL for the rows of ``digest`` over ``conversations`` and the odd conversation."""
    odd = r"\### Assistant: </turn> ok"
    words = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    quoted = lambda c: rf"len(regexp_replace({c}, '(</?\\*)turn', '\1\\turn', 'g'))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{odd}' UNION ALL SELECT -7, 1, 'assistant', '{odd}'),
t AS (SELECT *, {words} + {overhead} AS tokens FROM c),
n AS (SELECT *, row_number() OVER w - 1 AS n, sum(tokens) OVER w - tokens AS a FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                   ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, arg_min({{'n': n, 'role': role, 'text': text, 'tokens': tokens}}, n) AS sys
      FROM n WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT n.*, sys, CASE WHEN coalesce(sys.tokens, 0) < {budget} THEN {budget} - coalesce(sys.tokens, 0)
                            ELSE {budget} END AS room
      FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
k AS (SELECT *, least({history}, room // 2) AS back,
             greatest((room - least({history}, room // 2)) // 2, 1) AS cell FROM r),
o AS (SELECT *, floor(a / cell)::BIGINT * 2 + (tokens > cell)::INT AS own FROM k),
starts AS (SELECT conv_id, own AS win, min(a) AS start,
             CASE WHEN own % 2 = 1 THEN least(any_value(back), greatest(any_value(room) - sum(tokens), 0))
                  ELSE any_value(back) END AS repeated
           FROM o GROUP BY conv_id, own),
p AS (SELECT o.*, win, own = win AS new FROM starts JOIN o
      ON starts.conv_id IS NOT DISTINCT FROM o.conv_id
     AND (own = win OR own < win AND a >= start - repeated)),
again AS (SELECT conv_id, win, any_value(sys) AS sys FROM p WHERE sys IS NOT NULL
          GROUP BY conv_id, win HAVING NOT bool_or(n = sys.n)),
shown AS (
  SELECT conv_id, win, new, role, text, tokens FROM p
  UNION ALL SELECT conv_id, win, false, sys.role, sys.text, sys.tokens FROM again),
sizes AS (
  SELECT conv_id, count(DISTINCT win) AS n_windows, sum(tokens)::BIGINT AS n_tokens,
         sum(CASE WHEN new THEN {len(NEW)} ELSE {len(AGAIN)} END + {len(TEXT) + len(END)}
             + {quoted('role')} + {quoted('text')})::BIGINT AS formatted_chars
  FROM shown GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS all_said,
         coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS learnt
  FROM n GROUP BY conv_id)
SELECT d.conv_id, n_turns, n_windows, n_tokens, sha256(all_said) AS turns_sha256,
       length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM said d JOIN sizes z ON d.conv_id IS NOT DISTINCT FROM z.conv_id"""

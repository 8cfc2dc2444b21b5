"""Conversations as training windows of a token budget.

Turns are packed in order into windows of whole turns.  A window holds at
most ``budget`` tokens: the system turn (the first turn, if its role is
``system``) is retained in every window, up to ``history`` tokens of the turns
just before the window are repeated, and the rest is for new turns.  Prefix
sums of turn tokens choose both spans.  Loss falls on new assistant turns
only: a repeated target is masked.  A turn longer than what is left for new
turns has a window of its own and is kept whole (``over`` tells).

The template marks every turn as ``[TURN role]text[/TURN]`` inside ``<s>`` and
``</s>``.  Control strings inside texts are escaped: ``ESC e`` stands for the
escape character itself, and the first character of a control string becomes
``ESC a`` (``<``) or ``ESC l`` (``[``); ``unescaped`` reverses it exactly.

Everything is DataFrame functions, one row a turn: running sums over the turns
of a conversation (spilled where they are many) give the spans, each turn is
joined to the windows it belongs to, and only the turns of one window meet in
a row.  Packing is sequential, so conversations of up to ``LONG`` turns gather
their sizes, not their texts; longer ones take for each turn the turn at which
a window that begins there ends, and follow those jumps in doubling steps.
``read_back`` puts whole conversations together again, so those are bounded by
what a row holds (2 GB of text).

Defined results: turns are ordered by (turn, role, text), NULLs first;
repeated turns all stay; NULL text and role count as empty; NULL conversation
ids form one conversation; other columns are ignored; an empty table gives no
windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

BUDGET, HISTORY = 256, 64
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]"
#: Turns of which a conversation's sizes are gathered into one row.
LONG = 1024
ESC = "␛"
START, END, TURN, TURN_END = "<s>", "</s>", "[TURN ", "[/TURN]"
#: Strings with a meaning in this or in common chat templates.
CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[TURN ", "[/TURN]"]
CODES = {"<": ESC + "a", "[": ESC + "l"}


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "e"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(CODES[control[0]] + control[1:]))
    return out


def escaped_role(role: Column) -> Column:
    out = F.replace(role, F.lit(ESC), F.lit(ESC + "e"))
    for char, code in [*CODES.items(), ("]", ESC + "b")]:
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for char, code in [*CODES.items(), ("]", ESC + "b"), (ESC, ESC + "e")]:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _packed(sizes: Column, room: Column) -> Column:
    """Window number of every turn: the next turn opens a window when the
    prefix sum since the window's start would pass ``room``."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, n: Column) -> Column:
        opens = (s["used"] + n > room) & (F.size(s["of"]) > 0)
        w = F.when(opens, s["w"] + 1).otherwise(s["w"])
        return F.struct(w.alias("w"), F.when(opens, n).otherwise(s["used"] + n).alias("used"), F.array_append(s["of"], w).alias("of"))

    return F.aggregate(sizes, start, step, lambda s: s["of"])


def _joined(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Joined by conversation (NULL is one) and ``on``; other columns of ``b``
    have names of their own."""
    keys = ["conv", *on]
    right = b.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in b.columns])
    same = F.col("conv").eqNullSafe(F.col("__conv"))
    for c in on:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return a.join(right, same, how).drop(*[f"__{c}" for c in keys])


def _followed(turns: DataFrame) -> DataFrame:
    """(conv, i, before, window) of conversations of any length."""
    ends = turns.select("conv", "i", (F.col("before") + F.col("n")).alias("key"), F.lit(0).alias("asks"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("count"))
    asks = turns.filter("i >= system").select("conv", "i", (F.col("before") + F.col("room")).alias("key"), F.lit(1).alias("asks"), F.col("i").alias("from"), "count")
    fits = F.sum(1 - F.col("asks")).over(W.partitionBy("conv").orderBy("key", "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    jump = ends.unionByName(asks).withColumn("to", fits).filter("asks = 1").select("conv", "i", F.greatest(F.col("to"), F.col("from") + 1).alias("to"), "count")
    jump = written(jump.filter("to < count").drop("count"))
    reached = written(turns.filter("i = system").select("conv", "i", F.lit(0).cast("long").alias("window")))
    step = 1
    while True:  # reached has the first ``step`` windows, a jump passes as many
        more = written(_joined(reached, jump, "i").select("conv", F.col("to").alias("i"), (F.col("window") + step).alias("window")))
        if more.isEmpty():
            break
        reached = written(reached.unionByName(more))
        second = jump.select("conv", F.col("i").alias("to"), F.col("to").alias("end"))
        jump = written(_joined(jump, second, "to").select("conv", "i", F.col("end").alias("to")))
        step *= 2
    both = _joined(turns.select("conv", "i", "before"), reached, "i", how="left")
    last = F.last("window", ignorenulls=True).over(W.partitionBy("conv").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("window", F.coalesce(last, F.lit(0)).cast("int"))


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, i, before, window): the window in which each turn is new."""
    thin = turns.select("conv", "i", "n", "before", "room", "system", "count")
    conv = thin.filter(F.col("count") <= LONG).groupBy("conv", "room", "system").agg(F.array_sort(F.collect_list(F.struct("i", "before", "n"))).alias("turns"))
    # the system turn opens the first window without taking from its room
    sizes = F.transform("turns", lambda t: t["n"])
    rest = F.slice(sizes, F.col("system") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("system")))
    of = F.concat(F.when(F.col("system") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), _packed(rest, F.col("room")))
    out = conv.select("conv", F.explode(F.arrays_zip(F.col("turns").alias("t"), of.alias("w"))).alias("x")).select("conv", "x.t.i", "x.t.before", F.col("x.w").alias("window"))
    long = thin.filter(F.col("count") > LONG)
    return out if long.isEmpty() else out.unionByName(_followed(long))


def _members(of: DataFrame, system: DataFrame, history: int) -> DataFrame:
    """(conv, window, i, new): every turn of every window."""
    opened = of.filter("window > 0").groupBy("conv", "window").agg(F.min("before").alias("opens"))
    # a turn can be repeated by windows that open in its span of ``history`` tokens or in the next
    span = lambda c: F.floor(F.col(c) / max(1, history))
    near = opened.select("conv", F.col("window").alias("later"), "opens", F.explode(F.array(span("opens"), span("opens") - 1)).alias("span"))
    repeated = _joined(of.withColumn("span", span("before")), near, "span").filter((F.col("later") > F.col("window")) & (F.col("opens") - F.col("before") <= history))
    repeated = _joined(repeated.select("conv", F.col("later").alias("window"), "i"), system, "i", how="left_anti")
    retained = _joined(opened, system).select("conv", "window", "i")
    context = repeated.unionByName(retained).withColumn("new", F.lit(False))
    return of.select("conv", "window", "i", F.lit(True).alias("new")).unionByName(context)


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, formatted, n_context, n_new, loss, tokens, over): one
    row a window; ``n_context`` leading turns are retained or repeated, the
    ``n_new`` others are new; ``loss`` has (start, length) in code points of
    ``formatted``."""
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = given.withColumn("n", token_count(F.col("text"))).select(
        "conv", "role", "text", "n",
        (F.count(F.lit(1)).over(run) - 1).alias("i"),
        (F.sum("n").over(run) - F.col("n")).alias("before"),
        F.when(F.first("role").over(run) == "system", 1).otherwise(0).alias("system"),
        F.first("n").over(run).alias("first_n"),
        F.count(F.lit(1)).over(W.partitionBy("conv")).alias("count"),
    )
    fixed = F.when(F.col("system") == 1, F.col("first_n")).otherwise(F.lit(0).cast("long"))
    piece = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("]"), escaped(F.col("text")), F.lit(TURN_END))
    turn = written(
        placed.select(
            "conv", "i", "before", "n", "system", "count", "role",
            F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - fixed).alias("room"),
            piece.alias("piece"),
            F.length(escaped_role(F.col("role"))).alias("mark"),
        )
    )
    members = _members(written(_numbered(turn)), turn.filter("i = 0 and system = 1").select("conv", "i"), history)
    member = F.struct("i", "role", "piece", "mark", "n", "new")
    each = _joined(turn, members, "i").groupBy("conv", "window").agg(F.array_sort(F.collect_list(member)).alias("kept"), F.count_if("new").cast("int").alias("n_new"))
    each = each.withColumn("n_context", F.size("kept") - F.col("n_new"))

    def marked(kept: Column, n_context: Column) -> Column:
        """Spans of the texts of new assistant turns; ``at`` is the offset of
        the next piece."""
        start = F.struct(F.lit(len(START)).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

        def step(s: Column, t: Column) -> Column:
            head = F.lit(len(TURN) + 1) + t["mark"]
            span = F.struct((s["at"] + head).alias("start"), (F.length(t["piece"]) - head - len(TURN_END)).alias("length"))
            target = (s["i"] >= n_context) & (t["role"] == "assistant")
            return F.struct((s["at"] + F.length(t["piece"])).alias("at"), (s["i"] + 1).alias("i"), F.when(target, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(kept, start, step, lambda s: s["spans"])

    total = F.aggregate("kept", F.lit(0).cast("long"), lambda s, t: s + t["n"])
    return each.select(
        F.col("conv").alias(conv_col),
        "window",
        F.concat(F.lit(START), F.array_join(F.transform("kept", lambda t: t["piece"]), ""), F.lit(END)).alias("formatted"),
        "n_context",
        "n_new",
        marked(F.col("kept"), F.col("n_context")).alias("loss"),
        total.alias("tokens"),
        (total > budget).alias("over"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turns, targets, formatted_chars), from the windows alone: turns
    are (role, text) in order, targets the texts under the loss mask."""
    body = F.substring(F.col("formatted"), len(START) + 1, F.length("formatted") - len(START) - len(END))
    pieces = F.split(body, r"\[/TURN\]", -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.col("n_new"))

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, len(TURN) + 1, F.length(p)), "]", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, F.length(role) + len(TURN) + 2, F.length(p))).alias("text"))

    target = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = formatted.select(conv_col, F.struct("window", F.transform(new, turn).alias("turns"), target.alias("targets")).alias("w"), F.length("formatted").cast("long").alias("chars"))
    conv = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    return conv.select(conv_col, F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("ws", lambda w: w["targets"])).alias("targets"), "formatted_chars")

"""Chat formatting into budgeted windows, in DataFrame operations only.

A turn is written as ``[role]`` mark, escaped text, end mark.  Control strings can't occur in an escaped text:
their first character is escaped, and the escape itself too, so the text can be read back exactly.

Windows: within a part of PART turns of a conversation, prefix sums of the turns' tokens start a new window where the sum
since the window's first turn would pass what the budget leaves, after the system turn and, but for a conversation's first
window, a quarter of the budget for history.  So windows never part a turn.  Each window opens with the system turn
and repeats the last turns before it, at most ``history`` and as far as that quarter goes; what is repeated is marked so, and
of the targets (assistant turns) only those at home in a window are under its loss mask.  A window holds at most the budget,
unless it has a single turn at home that with the system turn alone is larger.  Every turn is thus at home once, and
every target is learnt once.  A window is named by the place of its first turn at home.

Places are found by a range partitioning on (conversation, turn, role, text's hash), so that a hot conversation is dealt over
many tasks whatever its turn numbers; a window's fold and its text are bounded by PART turns.  Only ``read_back``, which
puts a conversation's texts together again, needs them in one row, because its result does.

Cases: turns go by (turn, role, MD5 of the text), null first, and repeated rows are turns of their own; a null role is
written as an empty one, a null text as an empty text; a null conv_id is a conversation like another; the
system turn is kept at the front only if it is the first; empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import store

#: Marks of the template.  TURN opens a turn, MID parts role and text, END closes it; HIST opens a repeated one.
TURN, HIST, MID, END = "<s>[INST:", "<s>[HIST:", "]", "[/INST]</s>"
#: What may be part of a mark; the escape, a backslash, is one of them.
CONTROL = "[<\\[\\]\\\\]"
BUDGET, HISTORY, PART = 1024, 2, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({CONTROL})", "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"\\\\({CONTROL})", "$1")


def tokens(text: Column) -> Column:
    """An estimate of a turn's tokens: a quarter of its characters, and four for its marks."""
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + 4).cast("long")


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("hash").asc_nulls_first()]


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with an ``id`` that ascends by their order, written once; and (conv_id, id, pos, size, system) for each, without its text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumns({"hash": F.md5("text"), "tie": F.monotonically_increasing_id()})  # ties are of rows alike
    keys = [F.col("conv_id").asc_nulls_first(), *order(), F.col("tie")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    rows = store(rows.select("conv_id", "turn", "role", "text", "id"), "turns")
    at = F.expr("shiftright(id, 33)")
    # a conversation's turns in a partition lie together: their places follow from the first id and the turns before
    runs = rows.groupBy("conv_id", at.alias("at")).agg(F.min("id").alias("first"), F.count("id").alias("n"), F.min_by("role", "id").alias("role"), F.min_by(tokens(F.col("text")), "id").alias("lead"))
    along = W.partitionBy("conv_id").orderBy("at")  # a row a partition
    runs = runs.withColumns({"n0": F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "opener": F.first(F.struct("role", "lead")).over(along.rowsBetween(W.unboundedPreceding, 0))})
    system = F.when(F.col("opener.role") == "system", F.col("opener.lead"))
    runs = store(runs.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "first", "n0", system.alias("system")), "runs")
    light = rows.select("conv_id", "id", tokens(F.col("text")).alias("size")).join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (at == F.col("a")))
    return rows, light.select("conv_id", "id", (F.col("n0") + F.col("id") - F.col("first") + 1).alias("pos"), "size", "system")


def homes(light: DataFrame, budget: int) -> DataFrame:
    """(conv_id, id, pos, size, window, system) of each turn, window being the place of the first turn at home with it."""
    alone = F.when((F.col("pos") == 1) & F.col("system").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("size"))  # the system turn is charged to all
    part = light.withColumn("own", alone).groupBy("conv_id", F.expr(f"(pos - 1) div {PART}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size", "own"))).alias("t"), F.max("system").alias("system"))
    over = f"a.used > 0 and a.used + x.own > {budget} - coalesce(system, 0) - if(a.w = 1, 0, {budget // 4})"
    folded = part.withColumn("w", F.expr(
        "aggregate(t, named_struct('used', 0L, 'w', t[0].pos, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct("
        f"'used', if({over}, x.own, a.used + x.own), 'w', if({over}, x.pos, a.w), 'out', concat(a.out, array(if({over}, x.pos, a.w))))).out"
    ))
    return folded.select("conv_id", "system", F.explode(F.arrays_zip("t", "w")).alias("e")).select("conv_id", "e.t.id", "e.t.pos", "e.t.size", "e.t.own", F.col("e.w").alias("window"), "system")


def repeats(home: DataFrame, budget: int, history: int) -> DataFrame:
    """(id, window) of what the windows repeat: the system turn, and the last turns before that go into a quarter of the budget and into the window."""
    later = home.filter("window > 1").groupBy("conv_id", "window").agg(F.sum("own").alias("used"), F.first("system").alias("system"))
    room = F.least(F.lit(budget // 4), F.lit(budget) - F.coalesce("system", F.lit(0)) - F.col("used"))
    later = later.select(F.col("conv_id").alias("c"), F.col("window").alias("into"), room.alias("room"), F.col("system").isNotNull().alias("opened"))
    turn = home.select("conv_id", "pos", "id", "size")
    need = later.withColumn("q", F.explode(F.expr(f"sequence(greatest(window_first - {history}, 1L), window_first - 1)".replace("window_first", "into"))))
    found = need.join(turn, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("q"))).filter("not (opened and q = 1)")
    back = F.sum("size").over(W.partitionBy("c", "into").orderBy(F.col("q").desc()).rowsBetween(W.unboundedPreceding, 0))
    kept = found.withColumn("back", back).filter("back <= room").select("id", F.col("into").alias("window"))
    first = turn.filter("pos = 1").join(later.filter("opened"), F.col("conv_id").eqNullSafe(F.col("c"))).select("id", F.col("into").alias("window"))
    return kept.unionAll(first)


def written(role: Column, text: Column, repeated: Column) -> Column:
    return F.concat(F.when(repeated, F.lit(HIST)).otherwise(F.lit(TURN)), escape(role), F.lit(MID), escape(text), F.lit(END))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss): a window's text, and its loss mask as (start, length) in characters of it."""
    rows, light = placed(turns)
    home = store(homes(light, budget), "homes")
    places = home.select("id", "window", F.lit(False).alias("repeated")).unionAll(repeats(home, budget, history).select("id", "window", F.lit(True)))
    all_rows = rows.join(places, "id").withColumn("out", written(F.col("role"), F.col("text"), F.col("repeated")))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    part = F.struct(
        "id", "out", F.length("out").cast("long").alias("len"), F.coalesce(target, F.lit(False)).alias("target"),
        F.length(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(MID))).cast("long").alias("lead"), F.length(escape(F.col("text"))).cast("long").alias("body"),
    )
    made = all_rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    # offsets by prefix sums over the window's parts
    marks = F.expr(
        "aggregate(parts, named_struct('at', 0L, 'mask', cast(array() as array<struct<start: bigint, length: bigint>>)), (a, x) -> named_struct("
        "'at', a.at + x.len, 'mask', if(x.target, concat(a.mask, array(named_struct('start', a.at + x.lead, 'length', x.body))), a.mask))).mask"
    )
    return made.select("conv_id", "window", F.concat_ws("", F.col("parts.out")).alias("formatted"), marks.alias("loss"))


def parsed(formatted: str = "formatted") -> Column:
    """The turns in a window's text, repeated ones too: array of (repeated, role, text)."""
    # END can't occur inside a turn: its brackets would be escaped there
    pieces = F.slice(F.split(F.col(formatted), r"\[/INST\]</s>"), 1, F.size(F.split(F.col(formatted), r"\[/INST\]</s>")) - 1)
    head = r"^<s>\[(INST|HIST):([^\]\\]*+(?:\\.[^\]\\]*+)*+)\]"

    def turn(x: Column) -> Column:
        text = F.substring(x, F.length(F.regexp_extract(x, head, 0)) + 1, F.length(x))
        return F.struct((F.regexp_extract(x, head, 1) == "HIST").alias("repeated"), unescape(F.regexp_extract(x, head, 2)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars) per conversation, from the windows' texts and masks alone."""
    learnt = F.concat_ws("", F.transform("loss", lambda m: F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int"))))
    home = F.filter(parsed(), lambda t: ~t["repeated"])
    whole = F.concat_ws("", F.transform(home, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    rows = made.select("conv_id", F.struct("window", F.size(home).cast("long").alias("n"), whole.alias("turns"), unescape(learnt).alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))

    def total(f: str) -> Column:
        return F.aggregate(F.col(f"w.{f}"), F.lit(0).cast("long"), lambda a, x: a + x)

    return out.select("conv_id", total("n").alias("n_turns"), F.concat_ws("", F.col("w.turns")).alias("turns"), F.concat_ws("", F.col("w.loss")).alias("loss_text"), total("chars").alias("formatted_chars"))

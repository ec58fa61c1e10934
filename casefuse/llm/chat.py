"""Reply trees to formatted conversations, in DataFrame functions only.

Messages name the message they answer. Self-joins that double their reach take every message to its
root, with the length and the score of its branch; branches are ranked by mean score, and the paths
of the chosen leaves are enumerated by the same hops, longest first. So a chain of n messages takes
log2(n) joins upwards and as many downwards, and only paths that are formatted are ever written out.

A turn reads `<turn>ROLE<turn:>TEXT</turn>` and a line break. A `<turn` or `</turn` inside a role or
a text gets one backslash more behind its `<`, also where it has some already; reading takes one
away again, so every text comes back as it was.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.llm.common import written

OPEN, SAYS, CLOSE = "<turn>", "<turn:>", "</turn>\n"
TRAINED_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    """The text with its control strings made harmless."""
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def _one_row_per_message(messages: DataFrame) -> DataFrame:
    """Of rows with one id in a conversation that of the highest score, then of smallest digest."""
    first = Window.partitionBy("conv", "node").orderBy(
        F.col("score").desc_nulls_last(), F.xxhash64("parent", "role", "text"))
    return messages.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def _joined(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """`left` as l and `right` as r, met where l's column `at` is r's node."""
    return left.alias("l").join(right.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv"))
                                & (F.col(f"l.{at}") == F.col("r.node")))


def _hops(tree: DataFrame) -> tuple[list, DataFrame]:
    """(for each k the rows whose 2^k-th ancestor is known, root rows of all messages).

    Root rows hold `conv, node, n, total`: messages and score from the node up to its root. A
    message whose parents run in a circle has no root. Only row counts reach the driver.
    """
    count = F.count(F.lit(1))
    known = tree.select("conv", F.col("node").alias("up")).where("up IS NOT NULL")
    start = tree.alias("l").join(
        known.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv"))
        & (F.col("l.parent") == F.col("r.up")) & ~F.col("l.node").eqNullSafe(F.col("l.parent")),
        "left")
    rows, seen = written(start.select(
        "l.conv", "l.node", F.col("r.up").alias("anc"), F.lit(1).cast("long").alias("n"),
        F.coalesce(F.col("l.score").cast("double"), F.lit(0.0)).alias("total")),
        "hops", rows=count, open=F.count("anc"))
    done, hops, reach = rows.where("anc IS NULL"), [], 1
    moving, left = rows.where("anc IS NOT NULL"), seen["open"]
    while left and reach <= seen["rows"]:
        hops.append(moving)
        step, now = written(_joined(moving, done.unionByName(moving), "anc").select(
            "l.conv", "l.node", "r.anc", (F.col("l.n") + F.col("r.n")).alias("n"),
            (F.col("l.total") + F.col("r.total")).alias("total")), "hops", open=F.count("anc"))
        done, moving = done.unionByName(step.where("anc IS NULL")), step.where("anc IS NOT NULL")
        left, reach = now["open"], 2 * reach
    return hops, done.drop("anc")


def _paths(leaves: DataFrame, hops: list) -> DataFrame:
    """`conv, leaf, node, back` for every message above each leaf and the leaf itself.

    The distance of every ancestor is a sum of different powers of two, taken from the largest on,
    so each is reached once.
    """
    paths = leaves.select("conv", F.col("node").alias("leaf"), "node",
                          F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(hops))):
        more = _joined(paths, hops[k], "node").select(
            "l.conv", "l.leaf", F.col("r.anc").alias("node"), (F.col("back") + 2 ** k).alias("back"))
        paths = paths.unionByName(written(more, "paths"))
    return paths


def branches(messages: DataFrame, best: int = 1) -> tuple[DataFrame, list]:
    """(`conv, node, n, score, branch` of the chosen leaves, hops); messages as in `format_trees`."""
    tree = written(messages.select("conv", "node", "parent", "score"), "tree")
    hops, rooted = _hops(tree)
    if hops:
        answered = hops[0].select("conv", "anc").distinct()
        leaves = rooted.alias("l").join(
            answered.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv"))
            & F.col("l.node").eqNullSafe(F.col("r.anc")), "left_anti")
    else:
        leaves = rooted
    leaves = leaves.select("conv", "node", "n", (F.col("total") / F.col("n")).alias("score"))
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(
        F.col("score").desc(), F.col("n").desc(), "node")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    return written(ranked, "leaves"), hops


def format_trees(messages: DataFrame, conv_col: str = "conv_id", id_col: str = "message_id",
                 parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text",
                 score_col: str = None, best: int = 1, trained_roles=TRAINED_ROLES) -> DataFrame:
    """The `best` branches of every conversation (None: all), each as one formatted text.

    Gives `conv, leaf, branch, score, n_turns, formatted, turns`: `turns` holds for each turn
    `start, end` of its marked-up form in the text and `loss_start, loss_end` of what is trained on
    (null for other roles), in code points. A branch's score is the mean over its messages (null
    counts as 0); ties go to the longer branch, then to the smaller id of its leaf.

    A null role or text is empty; a null conversation id is one conversation. A message whose
    parent is null, itself or unknown is a root, and a conversation may have many. Of messages with
    one id only one counts (highest score, then smallest hash). Messages above which parents run in
    a circle have no path and are left out. Repeated rows count once, an empty table gives no rows,
    further columns are ignored.
    """
    rows = _one_row_per_message(messages.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{id_col}`").alias("node"),
        F.col(f"`{parent_col}`").alias("parent"), F.col(f"`{role_col}`").alias("role"),
        F.col(f"`{text_col}`").alias("text"),
        (F.col(f"`{score_col}`") if score_col else F.lit(0)).cast("double").alias("score")))
    chosen, hops = branches(rows, best)
    paths = _paths(chosen, hops).alias("p").join(
        rows.alias("m"), F.col("p.conv").eqNullSafe(F.col("m.conv"))
        & F.col("p.node").eqNullSafe(F.col("m.node")))
    role = F.coalesce("m.role", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(SAYS))
    pieces = paths.select(
        "p.conv", "p.leaf", (-F.col("back")).alias("at"), role.isin(*trained_roles).alias("trained"),
        F.length(head).cast("long").alias("head"),
        F.concat(head, escaped(F.coalesce("m.text", F.lit(""))), F.lit(CLOSE)).alias("piece"))
    along = Window.partitionBy("conv", "leaf").orderBy("at")
    end = F.sum(F.length("piece").cast("long")).over(along)
    placed = pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length("piece"))
    turn = F.struct("start", "end", F.when(F.col("trained"), F.col("start") + F.col("head")).alias(
        "loss_start"), F.when(F.col("trained"), F.col("end") - len(CLOSE)).alias("loss_end"))
    whole = placed.groupBy("conv", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", turn.alias("turn")))).alias("all"))
    whole = whole.select("conv", "leaf", F.array_join(F.col("all.piece"), "").alias("formatted"),
                         F.col("all.turn").alias("turns"))
    return whole.alias("w").join(
        chosen.alias("c"), F.col("w.conv").eqNullSafe(F.col("c.conv"))
        & F.col("w.leaf").eqNullSafe(F.col("c.node"))).select(
        "w.conv", "w.leaf", "c.branch", "c.score", F.col("c.n").alias("n_turns"), "w.formatted",
        "w.turns")


def read_turns(formatted: Column) -> Column:
    """Array of `role, text` out of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p.startswith(OPEN))
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2 ** 31 - 1), SAYS, 1)).alias(
            "role"),
        unescaped(F.split_part(p, F.lit(SAYS), F.lit(2))).alias("text")))


def read_trained(formatted: Column, turns: Column) -> Column:
    """Array of the texts that are trained on, cut out by their places in the formatted text.

    Each turn is cut out of its own part, so a long conversation is read once, not once a turn.
    """
    parts = F.slice(F.split(formatted, CLOSE, -1), F.lit(1), F.size(turns))
    return F.filter(F.zip_with(parts, turns, lambda p, t: unescaped(F.substring(
        p, (t["loss_start"] - t["start"] + 1).cast("int"),
        (t["loss_end"] - t["loss_start"]).cast("int")))), lambda t: t.isNotNull())


def chained(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as messages: each answers the one before it in its conversation.

    Turns come in order (null first), equal ones by role and by MD5 of the text; every row stays.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, role_col, F.md5(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(role_col).alias("role"),
                        F.col(text_col).alias("text"), F.row_number().over(order).alias("n"))
    return rows.select("conv_id", F.col("n").cast("long").alias("message_id"),
                       F.when(F.col("n") > 1, F.col("n") - 1).cast("long").alias("parent_id"),
                       "role", "text")


PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def with_planted(turns: DataFrame) -> DataFrame:
    """The turns, and a conversation of two that is full of control strings."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    planted = turns.sparkSession.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TEXT).alias("text"))
    return rows.unionByName(planted)


def format_report(turns: DataFrame) -> DataFrame:
    """`conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`, all read back
    from the formatted conversations."""
    whole = format_trees(written(chained(with_planted(turns)), "messages"))
    back = whole.select(
        F.col("conv").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_trained(F.col("formatted"), F.col("turns")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def report_sql() -> str:
    """The report over `conversations` in SQL."""
    marks = len(OPEN) + len(SAYS) + len(CLOSE)
    order = "ORDER BY turn NULLS FIRST, role, md5(text)"

    def size(text: str) -> str:
        return rf"length(regexp_replace({text}, '<(\\*/?turn)', '<\\\1', 'g'))"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}'
  UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + {size('role')} + {size('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

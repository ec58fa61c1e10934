"""Shards of near-equal bytes by a k-d tree over metadata.

The root is all rows. A node of k shards is split into nodes of floor(k/2) and ceil(k/2) shards at
the weighted median (more exactly, the matching quantile of bytes) along the dimension in which it
is widest, until leaves are one shard. Quantiles are exact: bytes are summed over cells of the
node's range, the cell that holds the cut is divided into cells again, and rows that agree in the
dimension are divided by a hash, until the cell at the cut is too small to matter. Nodes of a level
are treated together, and their cells stay in Spark: neither nodes nor rows reach the driver.

Text dimensions count by the rank of their values, all of them, so that values that begin alike are
as far apart as others. Rows of equal text stay together unless they outweigh a given share of a
shard; such a group is dealt into parts first, so that no group is too heavy to place.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, row_order, written
from casefuse.llm.common import numbered as in_order

OVERHEAD = 16
#: Cells a range is divided into at a time, and the numbering parts of a shard.
CELLS, PARTS = 2048, 256
#: A cut may be off by this share of a shard; a group may weigh this share before it is dealt out.
TOLERANCE, GROUP_SHARE = 0.0005, 0.02
_HASH = 1 << 31


def numeric(value: Column) -> Column:
    """A number as a double, null for NaN."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a text column replaced by the rank of its value; null comes first.

    Only distinct values are ordered, by ranges, so there may be as many as there are rows.
    """
    values = in_order(rows.select(F.col(column).alias("value")).distinct(), [], ["value"])
    values = written(values.select("value", F.col("pos").cast("double").alias("rank")), "ranks")
    met = rows.join(values, F.col(column).eqNullSafe(F.col("value")))
    return met.drop(column, "value").withColumnRenamed("rank", column)


def sized(docs: DataFrame, id_col: str, text_col: str, dimensions: list) -> DataFrame:
    """Rows without their text: id, size, CRC, a 128-bit digest of the text and the dimensions."""
    text = F.col(f"`{text_col}`")
    texts = [c for c, kind in docs.dtypes if kind == "string"]
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        mix64(text, seed=1).alias("t1"), mix64(text, seed=2).alias("t2"),
        *[(F.col(f"`{c}`") if c in texts else numeric(F.col(f"`{c}`"))).alias(f"d{i}")
          for i, c in enumerate(dimensions)],
        row_order(docs).alias("at"))


def points(rows: DataFrame, n_dims: int, limit: float) -> DataFrame:
    """`t1, t2, part, weight, h, d*`: groups of equal text, the heavy ones in parts below `limit`.

    A group lies where its smallest member lies, dimension by dimension.
    """
    groups = rows.groupBy("t1", "t2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("bytes") / F.lit(limit)))).cast(
        "long")
    heavy = written(groups.select("t1", "t2", parts.alias("parts")).where("parts > 1"), "heavy")
    # A row's part depends on the row alone, so that both uses below agree.
    dealt = rows.join(heavy, ["t1", "t2"], "left").withColumn("part", F.when(
        F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(
        F.pmod(mix64(F.col("doc_id"), F.col("at"), seed=5), F.col("parts")))).drop("parts")
    dealt = written(dealt, "dealt")
    return dealt, dealt.groupBy("t1", "t2", "part").agg(
        F.sum("size").alias("weight"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(n_dims)]
    ).withColumn("h", F.pmod(mix64(F.col("t1"), F.col("t2"), F.col("part"), seed=9), F.lit(_HASH)))


def _widest(pts: DataFrame, world: list, n_dims: int) -> DataFrame:
    """Per open node the dimension with the largest extent, relative to that of all rows."""
    nodes = pts.groupBy("node", "shards").agg(
        F.sum("weight").alias("total"),
        *[F.min(f"d{i}").alias(f"low{i}") for i in range(n_dims)],
        *[F.max(f"d{i}").alias(f"high{i}") for i in range(n_dims)])
    spans = F.array(*[F.struct(
        (F.when(F.lit(world[i] > 0), (F.col(f"high{i}") - F.col(f"low{i}")) / (world[i] or 1.0))
         .otherwise(0.0)).alias("extent"), F.lit(-i).alias("minus"), F.col(f"low{i}").alias("low"),
        F.col(f"high{i}").alias("high")) for i in range(n_dims)])
    best = F.array_max(spans)
    left = F.floor(F.col("shards") / 2)
    return nodes.select(
        "node", (-best["minus"]).alias("dim"), best["low"].alias("low"), best["high"].alias("high"),
        (F.col("total") * left / F.col("shards")).alias("goal"),
        (F.col("total") / F.col("shards")).alias("per_shard"),
        F.lit(False).alias("hashed"), F.lit(0.0).alias("before"), F.lit(False).alias("done"))


def _at(n_dims: int) -> Column:
    out = F.col("d0")
    for i in range(1, n_dims):
        out = F.when(F.col("dim") == i, F.col(f"d{i}")).otherwise(out)
    return out


def _narrowed(pts: DataFrame, cuts: DataFrame, n_dims: int) -> DataFrame:
    """One more division: the cell at each node's cut becomes its range.

    State of a cut: rows below `low` (in the dimension, or among rows of value `value` in the hash)
    are left and weigh `before`; rows in [low, high] are still open. `done` cuts put their open
    rows left of the cut or right of it, whichever is nearer.
    """
    open_ = pts.join(cuts.where("NOT done"), "node")
    x = F.when(F.col("hashed"), F.col("h").cast("double")).otherwise(_at(n_dims))
    inside = open_.withColumn("x", x).where(
        (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
        & (~F.col("hashed") | (_at(n_dims) == F.col("value"))))
    width = (F.col("high") - F.col("low")) / CELLS
    cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor(
        (F.col("x") - F.col("low")) / width))).otherwise(0)
    cells = inside.withColumn("cell", cell.cast("int")).groupBy(
        "node", "dim", "goal", "per_shard", "hashed", "value", "before", "cell").agg(
        F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.min("x").alias("low"),
        F.max("x").alias("high"))
    w = Window.partitionBy("node").orderBy("cell")
    cells = cells.withColumn("upto", F.col("before") + F.sum("w").over(w))
    cells = cells.withColumn("last", F.row_number().over(Window.partitionBy("node").orderBy(
        F.col("cell").desc())) == 1)
    holds = cells.where((F.col("upto") >= F.col("goal")) | F.col("last")).groupBy("node").agg(
        F.min_by(F.struct(*[c for c in cells.columns if c != "node"]), "cell").alias("c"))
    c = F.col("c")
    one = c["low"] == c["high"]
    fine = (c["w"] <= TOLERANCE * c["per_shard"]) | (c["n"] == 1) | (one & c["hashed"])
    to_hash = one & ~c["hashed"] & ~fine
    return holds.select(
        "node", c["dim"].alias("dim"), F.when(to_hash, 0.0).otherwise(c["low"]).alias("low"),
        F.when(to_hash, float(_HASH)).otherwise(c["high"]).alias("high"), c["goal"].alias("goal"),
        c["per_shard"].alias("per_shard"), (c["hashed"] | to_hash).alias("hashed"),
        F.when(to_hash, c["low"]).otherwise(c["value"]).alias("value"),
        (c["upto"] - c["w"]).alias("before"), fine.alias("done"),
        (c["upto"] - c["goal"] <= c["goal"] - (c["upto"] - c["w"])).alias("left"))


def cut_points(pts: DataFrame, world: list, n_dims: int) -> DataFrame:
    """The finished cut of every node that `pts` still has to split."""
    cuts = _widest(pts, world, n_dims).withColumn("value", F.lit(None).cast("double")).withColumn(
        "left", F.lit(False))
    cuts, seen = written(cuts, "cuts", open=F.count_if(~F.col("done")))
    while seen["open"]:
        narrow = _narrowed(pts, cuts, n_dims).select(*cuts.columns)
        cuts, seen = written(cuts.where("done").unionByName(narrow), "cuts",
                             open=F.count_if(~F.col("done")))
    return cuts


def tree(pts: DataFrame, shards: int, n_dims: int) -> DataFrame:
    """Points with `node`, the first shard of their leaf."""
    ends = pts.agg(*[F.max(f"d{i}") - F.min(f"d{i}") for i in range(n_dims)]).first()
    world = [float(e or 0) for e in ends]
    pts = pts.withColumn("node", F.lit(0).cast("long")).withColumn(
        "shards", F.lit(shards).cast("long"))
    left_shards = F.floor(F.col("shards") / 2)
    most = shards
    while most > 1:
        pts = written(pts, "points")
        inner = pts.where("shards > 1")
        cuts = cut_points(inner, world, n_dims).select(
            "node", "dim", "low", "high", "hashed", "value", "left")
        joined = pts.join(cuts, "node", "left")
        x = _at(n_dims)
        key = F.when(F.col("hashed"), F.col("h").cast("double")).otherwise(x)
        same = ~F.col("hashed") | (x == F.col("value"))
        goes_left = F.when(F.col("hashed") & (x != F.col("value")), x < F.col("value")).when(
            same & (key >= F.col("low")) & (key <= F.col("high")), F.col("left")).otherwise(
            key < F.col("low"))
        joined = joined.withColumn("to_left", (F.col("shards") == 1) | goes_left)
        pts = joined.select(
            *[c for c in pts.columns if c not in ("node", "shards")],
            F.when(F.col("to_left"), F.col("node")).otherwise(
                F.col("node") + left_shards).cast("long").alias("node"),
            F.when(F.col("shards") == 1, F.lit(1)).when(F.col("to_left"), left_shards).otherwise(
                F.col("shards") - left_shards).cast("long").alias("shards"))
        most -= most // 2
    return written(pts, "leaves")


def numbered(rows: DataFrame) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, numbered in PARTS parts of a shard."""
    rows = rows.withColumn("part", F.pmod(mix64(F.col("doc_id"), F.col("at"), seed=21),
                                          F.lit(PARTS)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    sizes = written(sizes.select("shard", "part", before.alias("before")), "sizes")
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "at"))
    return rows.withColumn("inner", inner).join(sizes, ["shard", "part"]).withColumn(
        "slot", F.col("before") + F.col("inner") - 1)


def kd_shards(docs: DataFrame, shards: int = None, target_bytes: int = None,
              dimensions: list = ("source", "lang", "n_chars"), id_col: str = "doc_id",
              text_col: str = "text", group_share: float = GROUP_SHARE) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` of every row.

    `shards` is their number; without it leaves are split until they reach `target_bytes`. The law
    is `bytes`: sizes are near equal. A row weighs its UTF-8 bytes and 16. A null text has no bytes
    and the CRC of an empty one; null and NaN metadata come first; null ids are kept. Rows of equal
    text share a shard unless they weigh more than `group_share` of one (None: always). Repeated
    rows are rows of one text. An empty table gives no rows; further columns are ignored.
    """
    dimensions = [d for d in dimensions if d in docs.columns]
    n_dims = max(1, len(dimensions))
    rows = sized(docs, id_col, text_col, dimensions)
    if not dimensions:
        rows = rows.withColumn("d0", F.lit(0.0))
    texts = [c for c, kind in rows.dtypes if kind == "string" and c[0] == "d" and c[1:].isdigit()]
    numbers = [c for c in rows.columns if c[0] == "d" and c[1:].isdigit() and c not in texts]
    rows, seen = written(rows, "sized", total=F.sum("size"), **{c: F.min(c) for c in numbers})
    total = seen["total"] or 0
    for c in texts:
        rows = ranked(rows, c)
    for c in numbers:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(float(seen[c] or 0) - 1)))
    shards = shards or max(1, -(-total // target_bytes))
    dealt, pts = points(rows, n_dims, max(
        1.0, total if group_share is None else group_share * total / shards))
    leaves = tree(pts, shards, n_dims).select(
        "t1", "t2", "part", F.col("node").cast("int").alias("shard"))
    placed = dealt.join(leaves, ["t1", "t2", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "at")
    return numbered(written(placed, "placed")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

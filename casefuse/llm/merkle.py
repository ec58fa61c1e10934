"""Merkle manifest of a dataset: a proof for every row, and the root folded from it again.

Rows are leaves of their group's tree, group roots are leaves of the dataset's tree. A tree is cut
into superblocks of 3^8 consecutive nodes. Going up, each superblock becomes one node of the next
table, until a group has one node. Going down, the nodes of a superblock and the proof above it
are cogrouped: one task redoes the small reduction, joins the inner and the outer part of every
proof, and folds it. So no task holds more than a superblock and one outer proof, whatever the size
of a group, and only digests are shuffled.

A proof is text: for each level from the leaf up the digests left of the node, `*`, those right of
it, and levels are joined by `/`.
"""

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import numbered, row_order, written

FAN_OUT, BLOCK_LEVELS = 3, 8


def field(value: Column) -> Column:
    """A value as `-` (null) or its UTF-8 length, `:` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def reduced(digests: list, n: int, fan_out: int, levels: int) -> list:
    """Layers of a superblock, its leaves first.

    `n` is the number of nodes of the whole table of its group: a superblock that is the whole tree
    ends at one node, any other one climbs all its levels.
    """
    layers = [digests]
    whole = n <= fan_out ** levels
    for _ in range(levels):
        last = layers[-1]
        if whole and len(last) == 1:
            break
        layers.append([_hash(*last[i:i + fan_out]) for i in range(0, len(last), fan_out)])
    return layers


def inner_proof(layers: list, i: int, fan_out: int) -> list:
    """Levels of the proof of node i inside its superblock."""
    proof = []
    for layer in layers[:-1]:
        first = i - i % fan_out
        proof.append("".join(layer[first:i]) + "*" + "".join(layer[i + 1:first + fan_out]))
        i //= fan_out
    return proof


def folded(digest: str, proof: str) -> str:
    """The root that a digest and its proof lead to."""
    for level in proof.split("/") if proof else ():
        digest = _hash(level.replace("*", digest))
    return digest


def _blocks(nodes: DataFrame, fan_out: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fan_out ** levels)).cast("long"))


def climb(nodes: DataFrame, fan_out: int = FAN_OUT, levels: int = BLOCK_LEVELS) -> list:
    """Tables of `tree, pos, n, digest`, from the given one to that of one node a tree.

    Only the largest `n` of a table reaches the driver; the number of tables is its logarithm to
    the base 3^8.
    """
    size = fan_out ** levels

    def up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        top = reduced(block["digest"].tolist(), n, fan_out, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // size)],
                             "digest": top})

    tables = [nodes]
    while True:
        above = _blocks(tables[-1].select("tree", "pos", "n", "digest"), fan_out, levels).groupBy(
            "tree", "block").applyInPandas(up, "tree string, pos long, n long, digest string")
        above, seen = written(above, "nodes", n=F.max("n"))
        tables.append(above)
        if (seen["n"] or 1) == 1:
            return tables


def descend(tables: list, outer: DataFrame, finish, schema: str, fan_out: int = FAN_OUT,
            levels: int = BLOCK_LEVELS) -> DataFrame:
    """What `finish` makes of the rows of the lowest table and their proofs.

    `outer` holds `tree, proof` and any further columns for every tree of the top table; the
    further ones come down with the proofs. `finish(rows, proofs, above)` gets the rows of one
    superblock in order, their proofs, and the row of `outer` that belongs to them.
    """
    above = outer.withColumn("block", F.lit(0).cast("long"))
    further = [c for c in outer.columns if c not in ("tree", "proof")]
    down = "tree string, block long, proof string" + "".join(
        f", {c} {outer.schema[c].dataType.simpleString()}" for c in further)

    def spread(rows, proofs, top):
        return pd.DataFrame({"tree": rows["tree"], "block": rows["pos"], "proof": proofs,
                             **{c: top[c] for c in further}})

    def cogrouped(make):
        def both(rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos")
            layers = reduced(rows["digest"].tolist(), int(rows["n"].iloc[0]), fan_out, levels)
            top = tops.iloc[0]
            ends = [top["proof"]] if top["proof"] else []
            return make(rows, ["/".join(inner_proof(layers, i, fan_out) + ends)
                               for i in range(len(rows))], top)
        return both

    for i in reversed(range(len(tables) - 1)):
        pairs = _blocks(tables[i], fan_out, levels).groupBy("tree", "block").cogroup(
            above.groupBy("tree", "block"))
        if i == 0:
            return pairs.applyInPandas(cogrouped(finish), schema)
        above = written(pairs.applyInPandas(cogrouped(spread), down), "proofs")


def manifest(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"),
             group: str = "source", order: str = "doc_id", changed: dict = None,
             fan_out: int = FAN_OUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """`id, leaf, subroot, root, proof, claim, folded_root` of every row, id being the order column.

    A leaf is the SHA-256 of the row's columns. Rows of a group ascend by the order column (null
    first), equal ones by leaf, and groups by their UTF-8 bytes (null first). `changed` maps columns
    to what a possibly changed copy of the data holds there; `claim` is the leaf of that copy and
    `folded_root` what it leads to with the proof of the original.

    Nulls are values of their own and a null group is a group. Repeated rows are leaves of their
    own. A dataset of one row has an empty proof, an empty table gives no rows, further columns
    are ignored.
    """
    now = {c: F.col(f"`{c}`") for c in columns}
    then = {**now, **(changed or {})}
    rows = docs.select(F.col(f"`{order}`").alias("id"), F.col(f"`{group}`").alias("group_value"),
                       digest_of(*now.values()).alias("digest"),
                       digest_of(*then.values()).alias("claim"), row_order(docs).alias("at_row"))
    rows = rows.withColumn("tree", field(F.col("group_value"))).withColumn(
        "claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    # Written first: ranges are sampled before rows are dealt, and texts are to be read once.
    leaves = numbered(written(rows, "rows"), ["group_value"], ["id", "digest", "at_row"]).select(
        "tree", "group_value", "pos", "n", "digest", "id", "claim")
    tables = climb(leaves, fan_out, levels)
    names = leaves.where("pos = 0").select("tree", "group_value")
    tops = tables[-1].select("tree", "digest").join(names, "tree")
    subroots = numbered(tops.withColumn("all", F.lit(0)), ["all"], ["group_value"]).select(
        F.lit("all").alias("tree"), "pos", "n", "digest", F.col("tree").alias("name"))
    subroots = written(subroots, "subroots")
    above = climb(subroots, fan_out, levels)
    root = above[-1].select("tree", F.lit("").alias("proof"), F.col("digest").alias("root"))

    def of_group(rows, proofs, top):
        return pd.DataFrame({"tree": rows["name"], "proof": proofs, "subroot": rows["digest"],
                             "root": top["root"]})

    outer = written(descend(above, root, of_group, "tree string, proof string, subroot string, "
                            "root string", fan_out, levels), "outer")
    id_kind = leaves.schema["id"].dataType.simpleString()

    def of_row(rows, proofs, top):
        claims = rows["claim"].where(rows["claim"].notna(), rows["digest"])
        return pd.DataFrame({
            "id": rows["id"], "leaf": rows["digest"], "subroot": top["subroot"],
            "root": top["root"], "proof": proofs, "claim": claims,
            "folded_root": [folded(d, p) for d, p in zip(claims, proofs)]})

    return descend(tables, outer, of_row, f"id {id_kind}, leaf string, subroot string, "
                   "root string, proof string, claim string, folded_root string", fan_out, levels)


def without_breaks(docs: DataFrame) -> dict:
    """A changed copy of documents: those whose id has an even CRC-32 lose their line breaks."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(
        F.col("text"))}


def manifest_report(docs: DataFrame) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` of documents."""
    return manifest(docs, changed=without_breaks(docs)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.translate("proof", "*/", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))

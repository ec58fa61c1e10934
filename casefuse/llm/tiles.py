"""Bounded comparison tasks out of buckets of any size.

A bucket of n items is dealt into chunks of about `size` items; every pair of chunks is one tile.
An item goes to as many tiles as its bucket has chunks, so all pairs of a bucket meet, no tile
holds more than two chunks, and a hot bucket is spread over many tasks. Buckets of one item vanish
before any payload is attached.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, written

TILE = ["key", "lo", "hi"]


def crowded(keyed: DataFrame, size: int, seeker: str = None) -> DataFrame:
    """Keys that hold a pair, with the number of chunks they are cut into.

    `seeker` names a boolean column: a pair then needs an item for which it is false.
    """
    n = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(~F.col(seeker)) if seeker else F.count(F.lit(1))).alias("found"))
    n = n.where((F.col("n") > 1) & (F.col("found") > 0))
    return n.select("key", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("chunks"))


def tiled(keyed: DataFrame, item: str, size: int, seeker: str = None) -> DataFrame:
    """The items once per tile: `key, lo, hi, chunk` in front of the other columns."""
    keys = written(crowded(keyed, size, seeker), "keys")
    return dealt(keyed.join(keys, "key"), item)


def dealt(rows: DataFrame, item: str) -> DataFrame:
    """Rows that know the `chunks` of their `key` once per tile, as `tiled` gives them."""
    rest = [c for c in rows.columns if c not in ("key", "chunks")]
    rows = rows.withColumn(
        "chunk", F.pmod(mix64(F.col(item), F.col("key"), seed=7), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("key", F.least("chunk", "other").alias("lo"),
                       F.greatest("chunk", "other").alias("hi"), "chunk", *rest)


def by_tile(tiles: DataFrame) -> DataFrame:
    """Every tile whole inside one partition, its rows next to each other."""
    return tiles.repartition(*TILE).sortWithinPartitions(*TILE)


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole tiles, with the first row of each; batch borders do not show."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        if not table.num_rows:
            continue
        starts = tile_starts(table)
        kept = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if kept is not None and kept.num_rows:
        yield kept, tile_starts(kept)


def tile_starts(table: pa.Table) -> np.ndarray:
    """The first row of each tile."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in TILE:
        v = table.column(name).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the given links.

    Links hook roots onto smaller roots, so nodes joined before follow their root; a link whose
    ends have one root is done with.
    """
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root

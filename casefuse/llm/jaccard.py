"""Near-duplicates by word shingles: SimHash candidates in MinHash buckets, exact Jaccard.

A text is the set of its five-word shingles. MinHash bands are the bucket keys, so that buckets
stay selective however wide the SimHash radius is; inside a bucket the five-word SimHashes are
compared bit-sliced. What is linked so far makes candidate groups. Inside each group (cut into
tiles) the shingle sets themselves are compared, and only pairs of the wanted Jaccard similarity
become links.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import packed, row_order, unpacked, utf8, written
from casefuse.llm.components import components
from casefuse.llm.simhash import SEED, close_links, grouped, shingles
from casefuse.llm.tiles import by_tile, tiled, whole_tiles

WIDTH, LEAST = 5, 0.8
#: A pair at 0.8 shares one of 20 bands of 5 values but for a chance of 0.0004.
BANDS, ROWS = 20, 5
#: The distance of a pair at 0.8 is 9.7 in the mean, with a spread of 2.9.
RADIUS = 24
#: Texts of a chunk; a tile holds the shingle sets of two chunks.
SIZE = 256
_RANDOM = np.random.default_rng(SEED)
_FLIP, _TIMES, _FOLD = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(3))
_TIMES, _FOLD = _TIMES * np.uint64(2) + np.uint64(1), _FOLD * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles(text, width)), np.uint64))


def set_simhash(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    high = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(high, bitorder="little").tobytes(), "little")


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the MinHash bands, one for each."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(len(_FLIP), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):  # a block of hashes under all functions at once
        np.minimum(low, ((hashes[i:i + 512, None] ^ _FLIP) * _TIMES).min(0), out=low)
    return (low * _FOLD).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


def sketch(text: Column, width: int = WIDTH) -> Column:
    """`whole, fp, keys`: a hash of the shingle set, its SimHash and its bands; null is empty."""
    kind = pa.struct([("whole", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<whole: long, fp: long, keys: array<long>>")
    def sketched(texts: pa.Array) -> pa.Array:
        whole, fp, keys = [], [], []
        for t in utf8(texts):
            s = shingle_set(t or b"", width)
            whole.append(xxhash.xxh3_64_intdigest(s.tobytes(), SEED))
            fp.append(set_simhash(s) if len(s) else 0)
            keys.append(bands(s).view(np.int64))
        columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, fp)]
        ends = np.cumsum([0, *map(len, keys)])
        columns.append(pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]))))
        return pa.StructArray.from_arrays(columns, fields=list(kind))
    return sketched(text)


def packed_set(text: Column, width: int = WIDTH) -> Column:
    """The shingle set of a text as bytes."""
    @F.arrow_udf("binary")
    def taken(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t or b"", width).tobytes() for t in utf8(texts)], pa.binary())
    return taken(text)


def similar(sets: list, least: float) -> tuple:
    """Links (i, j) of similarity `least` or more that span the groups all such pairs make."""
    size = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(numbers, np.cumsum(size)[:-1])
    here = np.zeros(numbers.max() + 1, np.int64)
    a, b, left = [], [], np.arange(len(sets))
    while len(left) > 1:
        queue, left, flat = [left[0]], left[1:], None
        while queue and len(left):
            i = queue.pop()
            if flat is None:
                flat = np.concatenate([parts[j] for j in left])
                starts = np.cumsum(size[left]) - size[left]
            here[parts[i]] = 1
            both = np.add.reduceat(here[flat], starts)
            here[parts[i]] = 0
            near = both / (size[i] + size[left] - both) >= least
            if near.any():
                queue += left[near].tolist()
                a += [i] * int(near.sum())
                b += left[near].tolist()
                left, flat = left[~near], None
    return a, b


def jaccard_links(rows: DataFrame, text: Column, least: float = LEAST, width: int = WIDTH,
                  size: int = SIZE) -> DataFrame:
    """Links (a, b) of `whole` that span all groups of texts of similarity `least` or more.

    `rows` is a written table with `whole`, `fp`, `keys` and what `text` reads. No pair below
    `least` is linked; of those above it, the ones that share no band are missed.
    """
    classes = written(rows.groupBy("whole").agg(F.min("fp").alias("fp"), F.min("keys").alias(
        "keys"), F.min("at").alias("at")), "sets")
    keyed = classes.select(F.explode("keys").alias("key"), "fp")
    found = written(components(close_links(classes, RADIUS, keyed=keyed)), "candidates")
    placed = classes.select("fp", "whole", "at").join(found, classes.fp == found.node, "left")
    placed = written(placed.select(F.coalesce("component", "fp").alias("key"), "whole", "at"),
                     "placed")
    tiles = written(tiled(placed, "whole", size), "tiles")
    asked = written(tiles.select("at").distinct(), "asked")
    sets = written(rows.select("at", text.alias("text")).join(asked, "at", "left_semi").select(
        "at", packed_set(F.col("text"), width).alias("hashes")), "shingles")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tiles(batches):
            whole, hashes = table.column("whole").to_numpy(), table.column("hashes").to_pylist()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(whole)]):
                kept = [i for i in range(s, e) if hashes[i]]
                if len(kept) > 1:
                    a, b = similar([np.frombuffer(hashes[i], np.uint64) for i in kept], least)
                    at = whole[kept]
                    yield pa.record_batch({"a": at[np.array(a, int)], "b": at[np.array(b, int)]})

    filled = tiles.join(sets, "at").select("key", "lo", "hi", "chunk", "whole", "hashes")
    return by_tile(filled).mapInArrow(links, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         least: float = LEAST) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row of smallest id stays.

    A group is what pairs of `least` or more connect. Texts without words are equal, and so are
    texts of equal shingles. Null ids come last; of rows with equal ids one stays. All columns are
    returned as they are.
    """
    columns = docs.columns
    rows = packed(docs, sketch(F.col(f"`{text_col}`")).alias("sketch"),
                  row_order(docs).alias("at"), F.col(f"`{id_col}`").alias("id"))
    rows = written(rows.select("row", "at", "id", "sketch.*"), "sketches")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("at"))
    links = jaccard_links(rows, F.col(f"row.`{text_col}`"), least)
    found = grouped(rows, order, key="whole", links=links)
    gone = rows.select("whole", "at").join(found, "whole").where(F.col("first.at") != F.col("at"))
    return unpacked(rows.join(written(gone.select("at"), "gone"), "at", "left_anti"), columns)

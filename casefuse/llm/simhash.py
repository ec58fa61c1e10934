"""SimHash near-duplicates, compared bit-sliced.

Fingerprints at a small Hamming distance share whole groups of bits: with `blocks` groups and
radius r, at least blocks - r groups agree. Every choice of that many groups is a bucket key, so
each close pair meets in some bucket. Inside a bucket (cut into tiles) the fingerprints are stored
as vertical bit planes, 64 fingerprints to a machine word; a query's planes are added into
bit-sliced counters by carry-save adders, and words in which every fingerprint has passed the
radius are abandoned.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import packed, row_order, unpacked, utf8, written
from casefuse.llm.components import components
from casefuse.llm.tiles import by_tile, local_components, tiled, whole_tiles

BITS = 64
SEED = 42
#: Pairs of (query, word of 64 lanes) that are compared at once.
PAIRS = 1 << 15
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = np.arange(8) * 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, width: int) -> list:
    """Overlapping runs of `width` words of a lower-cased text; a shorter text is one run."""
    words = text.lower().split()
    n = len(words)
    if n <= width:
        return [b" ".join(words)] if n else []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = [0, *(ends[:n - width] + 1).tolist()]
    return [flat[i:j] for i, j in zip(starts, ends[width - 1:].tolist())]


def simhash(text: bytes, width: int = 3) -> int:
    """Bits set in more than half of the shingle hashes; 0 for a text without words."""
    runs = shingles(text, width)
    if not runs:
        return 0
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in runs]), np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(runs)).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64-bit SimHash of a text as a long; null counts as empty."""
    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash(t or b"", width) for t in utf8(texts)), np.uint64, len(texts))
        return pa.array(out.view(np.int64))
    return hashed(text)


def bucket_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of keys; fingerprints within the radius share at least one."""
    size = BITS // blocks
    masks = [sum(((1 << (size if b < blocks - 1 else BITS - size * (blocks - 1))) - 1)
                 << (b * size) for b in chosen)
             for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m).cast("long")))
                     for t, m in enumerate(signed)])


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b, word w holds bit b of lanes 64w .. 64w+63."""
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2,
                         bitorder="little")
    turned = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(turned).view("<u8")[:, :, 0]


def close_lanes(queries, planes, q, w, radius: int):
    """Words of lanes within the radius of their query, for pairs (q[i], w[i]).

    `digits` are the bit-sliced counters. They start at 2^k - 1 - radius, so that a lane passes
    the radius exactly when the last adder carries out. Two planes enter at a time: a full adder
    makes their sum with the lowest counter and one carry.
    """
    k = int(radius).bit_length()
    at_first = (1 << k) - 1 - radius
    digits = [np.full(len(q), _ALL if at_first >> i & 1 else 0, np.uint64) for i in range(k)]
    over = np.zeros(len(q), np.uint64)
    alive = np.arange(len(q))
    far = np.full(len(q), _ALL)
    mine = queries[q]
    for bit in range(0, BITS, 2):
        x, y = (planes[b][w] ^ (np.uint64(0) - (mine >> np.uint64(b) & np.uint64(1)))
                for b in (bit, bit + 1))
        if k:
            both = digits[0] ^ x
            carry = digits[0] & x | both & y
            digits[0] = both ^ y
            for i in range(1, k):
                digits[i], carry = digits[i] ^ carry, digits[i] & carry
            over |= carry
        else:
            over |= x | y
        if bit % 8 == 6:
            keep = np.flatnonzero(over != _ALL)
            if len(keep) < len(alive):
                alive, q, w, mine, over = alive[keep], q[keep], w[keep], mine[keep], over[keep]
                digits = [d[keep] for d in digits]
                if not len(alive):
                    break
    far[alive] = over
    return ~far


def _tile_links(table: pa.Table, starts: np.ndarray, radius: int):
    """Spanning links of whole tiles: (fingerprint, smallest index of its local group)."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    lo, hi, chunk = (table.column(c).to_numpy() for c in ("lo", "hi", "chunk"))
    ends = np.append(starts[1:], len(fp))
    nodes_a, nodes_b, lanes, valid, pq, pw, n_words = [], [], [], [], [], [], 0

    def compared():
        q, w = np.concatenate(pq), np.concatenate(pw)
        rows = np.concatenate(lanes)
        planes = planes_of(np.where(rows < 0, np.uint64(0), fp[rows]))
        ok = np.packbits(rows.reshape(-1, 64) >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
        hit = close_lanes(fp, planes, q, w, radius) & ok[w]
        some = np.flatnonzero(hit)
        at, lane = np.nonzero(np.unpackbits(
            hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = q[some[at]], rows[w[some[at]] * 64 + lane]
        near = local_components(len(fp), a, b)
        a = np.flatnonzero(near != np.arange(len(fp)))  # a spanning set is all that is kept
        nodes_a.append(a)
        nodes_b.append(near[a])

    pending = 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        rows = np.arange(s, e)
        if lo[s] == hi[s]:
            ask, held = rows, rows
        else:
            ask, held = rows[chunk[s:e] == lo[s]], rows[chunk[s:e] == hi[s]]
        words = -(-len(held) // 64)
        if not len(ask) or not words:
            continue
        lanes.append(np.concatenate([held, np.full(words * 64 - len(held), -1)]))
        pq.append(np.repeat(ask, words))
        pw.append(np.tile(np.arange(n_words, n_words + words), len(ask)))
        n_words += words
        pending += len(ask) * words
        if pending >= PAIRS:
            compared()
            lanes, pq, pw, n_words, pending = [], [], [], 0, 0
    if pending:
        compared()
    if not nodes_a:
        return fp[:0], fp[:0]
    label = local_components(len(fp), np.concatenate(nodes_a), np.concatenate(nodes_b))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def close_links(fps: DataFrame, radius: int = 2, blocks: int = 4, size: int = 1024,
                keyed: DataFrame = None) -> DataFrame:
    """Links (a, b) that span all groups of distinct fingerprints `fp` within the radius.

    No link between two fingerprints further apart is made, and every closer pair ends up
    connected; inside a tile only a spanning set leaves the task, not all pairs. `keyed` gives
    other buckets (`key, fp`); then only pairs that share one are connected.
    """
    if keyed is None:
        keyed = fps.select(F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("key"), "fp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tiles(batches):
            a, b = _tile_links(table, starts, radius)
            yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

    return by_tile(tiled(keyed, "fp", size)).mapInArrow(links, "a long, b long")


def grouped(rows: DataFrame, order: Column, radius: int = 2, key: str = "fp",
            links: DataFrame = None) -> DataFrame:
    """`fp, first`: the smallest `order` among all rows reachable from a fingerprint.

    `rows` is a written table with `fp`; equal fingerprints are one class from the start. With
    `links` between values of another column `key`, that column takes the place of `fp`.
    """
    classes = written(rows.groupBy(key).agg(F.min(order).alias("first")), "classes")
    if links is None:
        links = close_links(classes.select("fp"), radius)
    linked = written(components(links), "components")
    members = classes.join(linked, classes[key] == linked.node).select(key, "component", "first")
    lowest = written(members.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    reached = written(members.join(lowest, "component").select(key, "lowest"), "reached")
    return written(classes.join(reached, key, "left").select(
        key, F.coalesce("lowest", "first").alias("first")), "grouped")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, radius: int = 2) -> DataFrame:
    """`doc_id, fingerprint, component_id` of every row.

    Null and blank texts have the fingerprint zero and link like any other. A null id takes part
    in links but is never the smallest; a component of null ids only has a null component_id.
    Repeated rows each give a row. An empty table gives none. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       fingerprint(F.col(text_col), width).alias("fp"))
    rows = written(rows, "fingerprints")
    found = grouped(rows, F.col("doc_id"), radius)
    return rows.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row of smallest id stays.

    Null ids come last; of rows with equal ids one stays. All columns are returned as they are.
    """
    columns = docs.columns
    rows = packed(docs, fingerprint(F.col(f"`{text_col}`"), width).alias("fp"),
                  row_order(docs).alias("at"), F.col(f"`{id_col}`").alias("id"))
    rows = written(rows, "fingerprints")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("at"))
    found = grouped(rows.select("fp", "at", "id"), order, radius)
    gone = rows.select("fp", "at").join(found, "fp").where(F.col("first.at") != F.col("at"))
    return unpacked(rows.join(written(gone.select("at"), "gone"), "at", "left_anti"), columns)

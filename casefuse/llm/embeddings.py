"""Near-duplicate embeddings: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
axis it then lies closest to, sign included. A table's bucket key joins the hashes of several
rotations. Each vector is stored in its own bucket of every table and looked up there and in the
next most likely buckets (one rotation answered by its second or third closest axis). Pairs that
meet are verified exactly; a pair counts in the first table and direction that finds it, so link
counts need no list of pairs, and only counts and spanning links leave a task.

One shuffle by bucket tells the rows that meet another class. They get their vectors before they
are dealt to tiles, so a large bucket is spread over tasks by its members first.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.llm.common import row_order, written
from casefuse.llm.components import components
from casefuse.llm.tiles import by_tile, dealt, local_components, tile_starts, whole_tiles


#: Vectors for which three rotations make buckets enough.
FEW = 1 << 17
#: Components that are hashed at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Hashing:
    """`tables` bucket keys of `rotations` hashes each, `probes` further buckets looked up."""
    tables: int = 10
    rotations: int = 3
    probes: int = 6
    seed: int = 5

    @classmethod
    def for_count(cls, n: int, dim: int) -> "Hashing":
        """Settings for `n` vectors: the number of buckets follows it, and so tables keep recall.

        A table has (2 width)^rotations buckets. Up to 2^17 vectors three rotations do; each further
        factor of 2 width takes one more, so that the unlike vectors a vector meets in a table do not
        grow with the input. The share of pairs at a cosine of 0.95 that a table finds is 0.59, 0.43
        and 0.30 at 3, 4 and 5 rotations (measured, 64 dimensions); tables are added until the share
        that all of them miss is about 0.0001.
        """
        base = 2 << max(1, (dim - 1).bit_length())
        more = max(0, math.ceil(math.log(max(1, n) / FEW, base)))
        found = 0.592 * 0.72 ** more
        return cls(math.ceil(-8.96 / math.log(1 - found)), 3 + more)

    @lru_cache(maxsize=4)
    def signs(self, width: int) -> np.ndarray:
        """Random signs by table, rotation, round and axis."""
        rng = np.random.default_rng(self.seed)
        return rng.choice((-1.0, 1.0), (self.tables, self.rotations, 3, width))

    def table(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Stored key of every row in table `t`, and the keys looked up there (the stored one first).

        Many rows are multiplied by the matrix of the rotations, block by block.
        """
        n, dim = unit.shape
        signs = self.signs(1 << max(1, (dim - 1).bit_length()))[t]
        if n < 4 * dim:
            return self.keys(rotated(unit, signs))
        turn = rotated(np.eye(dim), signs).reshape(dim, -1)
        blocks = [(unit[i:i + 512] @ turn).reshape(-1, *signs[:, 0].shape) for i in range(0, n, 512)]
        home, asked = zip(*map(self.keys, blocks))
        return np.concatenate(home), np.concatenate(asked)

    def keys(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of rows from their components by rotation and axis.

        Components are rounded to 30 binary places, so that neither the order of additions nor the
        other rows of a batch show in a key.
        """
        width = y.shape[2]
        weight = (2 * width) ** np.arange(self.rotations)
        y = np.rint(y * 2.0 ** 30)
        size = np.abs(y)
        hashes, sizes = [], []
        for _ in range(min(3, width)):
            axis = size.argmax(axis=2, keepdims=True)
            code = axis + width * (np.take_along_axis(y, axis, 2) < 0)
            hashes.append(code[:, :, 0] * weight)
            sizes.append(np.take_along_axis(size, axis, 2)[:, :, 0])
            np.put_along_axis(size, axis, -1, 2)
        home = hashes[0].sum(1)
        moves = np.concatenate([h - hashes[0] for h in hashes[1:]], 1)
        gaps = np.concatenate([sizes[0] - s for s in sizes[1:]], 1)
        likely = np.argsort(gaps, axis=1, kind="stable")[:, :self.probes]
        asked = np.repeat(home[:, None], 1 + self.probes, axis=1)
        asked[:, 1:1 + likely.shape[1]] += np.take_along_axis(moves, likely, 1)
        return home, asked

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored key of every row and table, and the keys looked up (the stored one first)."""
        stored, asked = zip(*[self.table(unit, t) for t in range(self.tables)])
        return np.stack(stored, 1), np.stack(asked, 1)


def rotated(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Components by row, rotation and axis after the rounds of signs and transforms of `signs`."""
    n, dim = unit.shape
    rotations, rounds, width = signs.shape
    y = np.zeros((n, rotations, width))
    y[:, :, :dim] = unit[:, None]
    for k in range(rounds):
        y = hadamard((y * signs[:, k]).reshape(-1, width)).reshape(y.shape)
    return y


def hadamard(y: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row."""
    n, width = y.shape
    step = 1
    while step < width:
        y = y.reshape(n, width // (2 * step), 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return y / np.sqrt(width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    low, high = F.array_min(vector), F.array_max(vector)
    whole = ~F.array_contains(vector, F.lit(float("nan")))  # null if a component is
    return F.coalesce(whole & (low > float("-inf")) & (high < float("inf"))
                      & ((low != 0) | (high != 0)), F.lit(False))


def bucket_rows(classes: DataFrame, how: Hashing) -> DataFrame:
    """`key, cid, seeker`: where a class is stored (not seeker) and looked up (seeker).

    The key is `how.tables` times the code plus the table, below 2^63 up to 2^29 vectors of 2048
    components or 2^33 of 64.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cid = part.column("cid").to_numpy()
                step = max(1, BLOCK // dim)
                for i in range(0, len(cid), step):
                    unit = _unit(_matrix(part.column("vector")[i:i + step], dim))
                    for t in range(how.tables):
                        home, asked = how.table(unit, t)
                        fresh = asked != home[:, None]
                        fresh[:, 0] = True
                        row, probe = np.nonzero(fresh)
                        yield pa.record_batch({"key": asked[row, probe] * how.tables + t,
                                               "cid": cid[i + row], "seeker": probe > 0})
    rows = classes.select("cid", "vector", F.size("vector").alias("dim"))
    return rows.mapInArrow(keys, "key long, cid long, seeker boolean")


def met_rows(classes: DataFrame, how: Hashing, size: int) -> DataFrame:
    """The bucket rows that share a bucket with a stored class, and the chunks of the bucket."""
    bucket = Window.partitionBy("key")
    rows = bucket_rows(classes, how).select(
        "*", F.count(F.lit(1)).over(bucket).alias("n"),
        F.count_if(~F.col("seeker")).over(bucket).alias("stored"))
    return rows.where((F.col("n") > 1) & (F.col("stored") > 0)).select(
        "key", "cid", "seeker", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("chunks"))


def _near_pairs(table: pa.Table, unit: np.ndarray, threshold: float):
    """Rows (looked up, stored) of two classes in one tile whose cosine is at the threshold.

    Two stored rows of one bucket are found once only, from the smaller class.
    """
    lo, hi, chunk, cid = (table.column(c).to_numpy() for c in ("lo", "hi", "chunk", "cid"))
    seeker = table.column("seeker").to_numpy()
    starts = tile_starts(table)
    ends = np.append(starts[1:], len(cid))
    found = [(np.empty(0, int), np.empty(0, int))]
    # Small tiles: rows that lie a given distance apart, of all tiles at once.
    small = (ends - starts <= 32) & (lo[starts] == hi[starts])
    rows, end = np.flatnonzero(np.repeat(small, ends - starts)), np.repeat(ends, ends - starts)
    apart = 1
    while len(rows := rows[rows + apart < end[rows]]):
        near = rows[np.einsum("ij,ij->i", unit[rows], unit[rows + apart]) >= threshold]
        found += [(near, near + apart), (near + apart, near)]
        apart += 1
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
        if lo[s] == hi[s]:
            q, i = np.nonzero((unit[s:e] @ unit[s:e].T >= threshold) & ~seeker[s:e])
            found.append((s + q, s + i))
        else:
            a, b = (s + np.flatnonzero(chunk[s:e] == x) for x in (lo[s], hi[s]))
            near = unit[a] @ unit[b].T >= threshold
            for ask, held, met in ((a, b, near), (b, a, near.T)):
                q, i = np.nonzero(met & ~seeker[held])
                found.append((ask[q], held[i]))
    q, i = (np.concatenate(x) for x in zip(*found))
    once = ~seeker[i] & ((cid[q] < cid[i]) | seeker[q] & (cid[q] != cid[i]))
    return q[once], i[once]


def _first_met(slot, q, i, unit, how: Hashing) -> np.ndarray:
    """Whether classes q and i meet neither in a table before `slot` nor, if q > i, there as i and q.

    `unit` holds the vectors of the classes. Most pairs meet in one of the first tables, so only
    those still open are hashed for the next.
    """
    first = np.ones(len(q), bool)
    for t in range(how.tables):
        rest = np.flatnonzero(first & ((slot > t) | (slot == t) & (q > i)))
        if len(rest):
            a, b = q[rest], i[rest]
            used = np.zeros(len(unit), bool)
            used[a] = used[b] = True
            home, asked = how.table(unit[used], t)
            place = np.cumsum(used) - 1
            a, b = place[a], place[b]
            forth = np.any([key[a] == home[b] for key in asked.T], axis=0) & (slot[rest] > t)
            back = np.any([key[b] == home[a] for key in asked.T], axis=0)
            first[rest] = ~(forth | back)
    return first


def verified(classes: DataFrame, threshold: float, how: Hashing, size: int = 512) -> DataFrame:
    """`a, b, add`: links add to (b null) or span (add null) between classes at the threshold.

    `classes` is a written table of `cid, vector, members` with distinct usable vectors.
    """
    vectors = classes.select("cid", "vector", F.size("vector").alias("dim"), "members")
    rows = by_tile(dealt(met_rows(classes, how, size).join(vectors, "cid"), "cid"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_tiles(batches):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim))
                unit = _unit(_matrix(part.column("vector"), dim))
                q, i = _near_pairs(part, unit, threshold)
                ids, row, at = np.unique(part.column("cid").to_numpy(), return_index=True,
                                         return_inverse=True)
                weight = part.column("members").to_numpy()[row]
                slot, q, i = part.column("key").to_numpy()[q] % how.tables, at[q], at[i]
                first = _first_met(slot, q, i, unit[row], how)
                q, i = q[first], i[first]
                total = np.bincount(np.append(q, i), np.append(weight[i], weight[q]), len(ids))
                linked = np.flatnonzero(total)
                label = local_components(len(ids), q, i)
                far = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.record_batch({
                    "a": ids[np.append(linked, far)],
                    "b": pa.array(np.append(np.full(len(linked), -1), ids[label[far]]),
                                  mask=np.arange(len(linked) + len(far)) < len(linked)),
                    "add": np.append(total[linked], np.zeros(len(far))).astype(np.int64)})

    return rows.mapInArrow(links, "a long, b long, add long")


def link_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vector_col: str = "embedding", how: Hashing = None) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different length do not link. Equal vectors are one class from the start and link
    with each other. A null id takes part in links but is never the smallest: its own kept is null
    unless a component has another id. Repeated rows each give a row and link with each other; an
    empty table gives none. Further columns are ignored. Hashing may miss a pair near the
    threshold; the README states the measured recall. `how` is by default `Hashing.for_count`.
    """
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = written(vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"),
        row_order(vectors).alias("at")), "vectors")
    good = rows.where(usable(F.col("vector")))
    classes, seen = written(good.groupBy("vector").agg(
        F.min("at").alias("cid"), F.min("vec_id").alias("first"),
        F.count(F.lit(1)).alias("members")), "classes", n=F.count(F.lit(1)),
        dim=F.max(F.size("vector")))
    how = how or Hashing.for_count(seen["n"], seen["dim"] or 1)
    found = written(verified(classes, threshold, how), "verified")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("add").alias("more"))
    linked = written(components(found.where("b IS NOT NULL").select("a", "b")), "components")
    members = classes.join(linked, classes.cid == linked.node).select("cid", "component", "first")
    lowest = written(members.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    reached = written(members.join(lowest, "component").join(counts, "cid").select(
        "cid", "lowest", "more"), "reached")
    known = classes.join(reached, "cid", "left").select(
        "vector", "first", "members",
        (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("lowest", "first").alias("component_id"))
    # Only copies need their class looked up by vector.
    single = known.where("members = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
    copied = written(known.where("members > 1").select("vector", "n_links", "component_id"), "copied")
    copies = good.select("vec_id", "vector").join(copied, "vector").drop("vector")
    alone = rows.where(~usable(F.col("vector"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return single.unionByName(copies).unionByName(alone).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))

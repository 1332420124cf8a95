"""Near-duplicate embeddings by lattice hashing.

Each of several tables projects the unit vectors at random to eight dimensions and decodes them to the nearest point of the
E8 lattice. A vector is a member of its own cell and of the neighbouring cells whose points come next in distance, so
that two similar vectors on either side of a border still share a cell. All pairs of a cell are compared by their
true cosine, in blocks, as matrix products; only counts and the links of a spanning forest leave a block. A pair that
shares several cells is counted in the least of them.

Equal vectors are one class with a multiplicity from the start, so a vector that fills a third of the table is one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import connected_components, mix
from concord.session import cut_lineage

#: Tables, neighbouring cells probed in each, and lattice units for a distance of one between unit vectors.
TABLES, PROBES, SCALE = 8, 3, 2.0
#: Members of a block of a large cell.
BLOCK = 1500


def shortest() -> np.ndarray:
    """The 240 shortest lattice vectors: two coordinates of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out.extend(np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0)
    return np.array(out)


NEIGHBOURS = shortest()


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where the sum is odd, the worst rounded coordinate is rounded the other way."""
    out = np.rint(y)
    error = y - out
    worst = np.abs(error).argmax(1)
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    out[odd, worst[odd]] += np.where(error[odd, worst[odd]] >= 0, 1, -1)
    return out


def nearest_point(y: np.ndarray) -> np.ndarray:
    """E8 is the even points and the same moved by one half in all coordinates."""
    whole, half = nearest_even(y), nearest_even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Keys of the cells of each vector, sorted within the row."""
    lane = np.random.default_rng(17).integers(0, 1 << 63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for t in range(tables):
        rng = np.random.default_rng([19, t, unit.shape[1]])
        # a random direction keeps the length of a difference on average
        y = unit @ (rng.normal(size=(unit.shape[1], 8)) * (scale / np.sqrt(8)))
        home = nearest_point(y)
        gain = (y - home) @ NEIGHBOURS.T
        points = [home]
        if probes:
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            points.extend(home + NEIGHBOURS[best[:, i]] for i in range(probes))
        for point in points:
            number = (np.rint(point * 2).astype(np.int64).view(np.uint64) * lane[:8]).sum(1, dtype=np.uint64)
            table = (int(lane[8]) * (t + 1) + unit.shape[1]) % (1 << 64)
            out.append(mix(number + np.uint64(table)))
    return np.sort(np.stack(out, 1).view(np.int64), axis=1)


def usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def compare(group: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one block pair of a cell: classes, the number of vectors that each links with here (pairs that share a lesser
    cell are left out), and a class that stands for each one's component here."""
    c, side, count = (group[n].to_numpy() for n in ("c", "side", "n"))
    key = group["cell"][0].as_py()
    unit = np.array(group["unit"].combine_chunks().flatten()).reshape(len(c), -1)
    member = np.array(group["cells"].combine_chunks().flatten()).reshape(len(c), -1)
    order = np.argsort(c)
    c, side, count, unit, member = c[order], side[order], count[order], unit[order], member[order]
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if side[0] != 2:
        linked &= side[:, None] != side
    # pairs that share a cell with a lesser key
    lesser, where = np.unique(np.where(member < key, member, key), return_inverse=True)
    marks = np.zeros((len(c), len(lesser)), np.float32)
    marks[np.repeat(np.arange(len(c)), member.shape[1]), where.ravel()] = 1
    marks[:, lesser == key] = 0
    links = (linked & (marks @ marks.T == 0)) @ count
    # least class that links reach inside the block
    root = np.arange(len(c))
    while True:
        low = np.minimum(root, np.where(linked, root, len(c)).min(1, initial=len(c)))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return c, links, c[root]


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id that links reach) and kept.

    Two vectors link if their cosine, in double precision, is at least `least`; vectors that are null, empty, zero, or hold
    nulls or non-finite numbers link with nothing, as do vectors of different lengths with each other. Equal vectors are found
    always, others if they share a cell. Repeated rows are vectors of their own; a null id links but names no component and
    is not kept. An empty table gives no row.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            sizes = np.array(values.value_lengths())
            flat, ends = np.array(values.flatten()), np.r_[0, np.cumsum(sizes)]
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                # a largest part of one keeps squares in range
                vectors = np.stack([flat[ends[i] : ends[i + 1]] for i in mine])
                vectors = vectors / np.abs(vectors).max(1, keepdims=True)
                unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
                rows = pa.array(mine)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype))) for a in (unit, cells(unit, tables, probes, scale))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *lists], ["c", "n", "unit", "cells"])

    def inside(group: pa.Table) -> pa.Table:
        c, links, root = compare(group, least)
        some = (links > 0) | (c != root)
        return pa.table({"c": c[some], "links": links[some].astype(np.int64), "root": root[some]})

    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    rows = rows.withColumn("c", F.when(usable(F.col("v")), F.xxhash64("v", F.size("v"))))
    classes = rows.where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("v").alias("v"))
    classes = cut_lineage(classes, "classes")
    placed = classes.select("c", "n", "v").mapInArrow(place, "c long, n long, unit array<double>, cells array<long>")
    placed = cut_lineage(placed, "placed")
    members = placed.select("c", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = members.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    sizes = cut_lineage(sizes.select("cell", F.ceil(F.col("m") / BLOCK).alias("blocks")), "cells")
    members = members.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("c", "cell"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    members = members.select("cell", "c", "block", other)
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
    members = members.select("cell", "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side)
    blocks = members.join(placed, "c").groupBy("cell", "i", "j")
    found = cut_lineage(blocks.applyInArrow(inside, "c long, links long, root long"), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.join(roots, classes.c == roots.node, "left").select("c", "n", "first", F.coalesce("root", "c").alias("root"))
    named = named.join(links, "c", "left").select("c", "root", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = cut_lineage(named, "class-roots")
    groups = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(groups, "root").select("c", "n_links", "component")
    out = rows.select("id", "c").join(named, "c", "left")
    component = F.coalesce("component", "id")
    kept = F.coalesce(component == F.col("id"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept")
    )


#: The same over `embeddings`, comparing all pairs.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM v
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(reach.b) AS component_id,
  min(reach.b) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id GROUP BY e.vec_id
"""

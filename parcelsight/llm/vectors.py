"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are linked within an Euclidean distance that the cosine fixes. They are sorted by
the grid cells of their leading principal coordinates, cells being as wide as that distance, and
cut into sequence intervals (blocks). Pairs of blocks whose boxes are within reach meet in one
task, which halves both intervals again and again and leaves pairs that are provably distant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.components import connected_components
from parcelsight.llm.shared import written

LEADING = 8
BLOCK_BYTES = 1 << 19
#: Intervals of so many vectors are compared outright.
SMALL = 128
#: Slack of distances, for rounding; cosines decide.
SLACK = 1e-9


def _unit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units, dims = [], []
        for v in batch["embedding"]:
            x = None if v is None else np.asarray(v, np.float64)
            size = 0.0 if x is None or not len(x) else float(np.sqrt((x * x).sum()))
            ok = np.isfinite(size) and size > 0
            units.append((x / size).tobytes() if ok else None)
            dims.append(len(x) if ok else 0)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "dim": dims,
                            "unit": units}).astype({"vec_id": "Int64", "label": "Int64"})


def _basis(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of all unit vectors, by number of dimensions."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(dim * dim), "x": total.reshape(-1)})

    rows = classes.select("dim", "unit").mapInPandas(partial, "dim long, at long, x double")
    moments: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim", "at").agg(F.sum("x").alias("x")).collect():  # dim^2 numbers
        moments.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["at"]] = r["x"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1][:, :LEADING]
            for d, m in moments.items()}


def _blocks(classes: DataFrame, basis: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Sequence intervals of the grid order: nodes, sizes and unit vectors as bytes, and a box."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.full((len(batch), LEADING), 0.0)
            for dim, at in batch.groupby("dim").indices.items():
                x = np.frombuffer(b"".join(batch["unit"].iloc[at]), np.float64).reshape(-1, dim)
                q = x @ basis[dim]
                p[at, :q.shape[1]] = q
            batch["coordinates"] = list(p)
            batch["cells"] = list(np.floor(p / reach).astype(np.int32))
            yield batch

    schema = "label long, dim long, node long, size long, unit binary"
    placed = classes.select("label", "dim", "node", "size", "unit").mapInPandas(
        place, schema + ", coordinates array<double>, cells array<int>")
    order = ["label", "dim", "cells", "node"]
    in_order = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, key = TaskContext.get().partitionId() << 33, [], None

        def block():
            nonlocal number
            p = np.stack([r.coordinates for r in held])
            number += 1
            return pd.DataFrame({
                "block": [number], "label": [key[0]], "dim": [key[1]],
                "nodes": [np.array([r.node for r in held], np.int64).tobytes()],
                "sizes": [np.array([r.size for r in held], np.int64).tobytes()],
                "units": [b"".join(r.unit for r in held)],
                "lo": [p.min(axis=0)], "hi": [p.max(axis=0)]})

        for batch in batches:
            for r in batch.itertuples():
                if held and ((r.label, r.dim) != key
                             or len(held) * 8 * r.dim >= BLOCK_BYTES):
                    yield block()
                    held = []
                key = (r.label, r.dim)
                held.append(r)
        if held:
            yield block()

    return written(in_order.mapInPandas(
        cut, "block long, label long, dim long, nodes binary, sizes binary, units binary, "
             "lo array<double>, hi array<double>"), "blocks")


def _pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(one, two): blocks of a label whose boxes are within reach, each pair once."""
    box = blocks.select("block", "label", "dim", "lo", "hi")
    cell = lambda side, k: F.floor(F.col(side)[0] / reach) + k
    a = box.select("label", "dim", F.col("block").alias("one"), F.col("lo").alias("lo1"),
                   F.col("hi").alias("hi1"),
                   F.explode(F.sequence(cell("lo", 0), cell("hi", 0))).alias("slot"))
    b = box.select("label", "dim", F.col("block").alias("two"), F.col("lo").alias("lo2"),
                   F.col("hi").alias("hi2"),
                   F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("slot"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo2")[k] - F.col("hi1")[k],
                                F.col("lo1")[k] - F.col("hi2")[k]), 2) for k in range(LEADING)),
              F.lit(0.0))
    return (a.join(b, ["label", "dim", "slot"])
            .where((F.col("one") <= F.col("two")) & (gap <= reach * reach + SLACK))
            .select("one", "two").distinct())


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float,
                   reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of two intervals in grid order."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        apart = np.maximum(0, np.maximum(py[c:d].min(axis=0) - px[a:b].max(axis=0),
                                         px[a:b].min(axis=0) - py[c:d].max(axis=0)))
        if (apart * apart).sum() > reach * reach + SLACK:
            continue
        if b - a <= SMALL and d - c <= SMALL:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            found.append((i + a, j + c))
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _smallest(n: int, i: np.ndarray, j: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest node of its component under the links (i, j)."""
    label = nodes.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new


def _linked(blocks: DataFrame, basis: dict[int, np.ndarray], least: float, reach: float
            ) -> DataFrame:
    """(node, links, root): per pair of blocks, linked vectors of other nodes, and a forest."""
    pairs = _pairs(blocks, reach)
    sides = pairs.select("one", "two", F.explode(F.array("one", "two")).alias("block")).distinct()
    met = sides.join(blocks.drop("lo", "hi", "label"), "block")

    def link(key, batch: pd.DataFrame) -> pd.DataFrame:
        rows = {r.block: r for r in batch.itertuples()}
        one, two = rows[key[0]], rows[key[1]]
        read = lambda r: (np.frombuffer(r.nodes, np.int64), np.frombuffer(r.sizes, np.int64),
                          np.frombuffer(r.units, np.float64).reshape(-1, r.dim))
        (m, s, x), (n, t, y) = read(one), read(two)
        v = basis[one.dim]
        i, j = join_intervals(x, y, x @ v, y @ v, least, reach)
        if key[0] == key[1]:
            other = i != j
            i, j = i[other], j[other]
            links = np.bincount(i, t[j], len(m))
            nodes = m
        else:
            links = np.concatenate((np.bincount(i, t[j], len(m)), np.bincount(j, s[i], len(n))))
            nodes, j = np.concatenate((m, n)), j + len(m)
        root = _smallest(len(nodes), i, j, nodes)
        got = links > 0
        return pd.DataFrame({"node": nodes[got], "links": links[got].astype(np.int64),
                             "root": root[got]})

    return written(met.groupBy("one", "two").applyInPandas(
        link, "node long, links long, root long"), "links")


def decide(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are linked when their labels and dimensions are equal and their cosine, in double
    precision, is at least ``least``. Null or zero vectors, vectors with null or non-finite
    components, and rows with a null label or id link with nothing and are kept. Equal vectors
    are compared once and count as often as they occur; rows repeated with one id count each.
    No rows: no rows. Further columns are left out.
    """
    reach = float(np.sqrt(2 - 2 * least))
    rows = vectors.select("vec_id", "label", "embedding").mapInPandas(
        _unit_rows, "vec_id long, label long, dim long, unit binary")
    rows = rows.withColumn("set", F.when(
        F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
        F.sha2(F.concat(F.col("label").cast("string").cast("binary"),
                        F.lit(":").cast("binary"), F.col("unit")), 256)))
    rows = written(rows, "units")
    classes = written(rows.where("set IS NOT NULL").groupBy("set").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("size"),
        F.first("label").alias("label"), F.first("dim").alias("dim"),
        F.first("unit").alias("unit")), "classes")
    basis = _basis(classes)
    linked = _linked(_blocks(classes, basis, reach), basis, least, reach)
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = (
        classes.select("set", "node", "size").join(links, "node", "left")
        .join(connected_components(linked, "node", "root"), "node", "left")
        .select("set", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "node").alias("component_id")))
    return (
        rows.select("vec_id", "set").join(written(found, "found"), "set", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))

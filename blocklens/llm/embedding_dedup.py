"""Embedding near-dedup: spherical k-means cells, blocked cosines, components.

Vectors are grouped by their nearest centroid.  Products are taken between a
cell's residents, and between its residents and those vectors of later cells
that could still lie within the threshold of one of them.  For unit vectors x
at home with centroid a and y at home with b, cos(x, y) >= t bounds |x - y| by
sqrt(2 - 2t); x is nearer to a than to b, so y can have such a partner only if

    y.b - y.a <= sqrt(2 - 2t) * |b - a|.

So no link is lost however the cells fall; good cells only save work.  Cells
are cut into blocks and a block's visitors into batches, so no task depends on
the size of a cell.  Equal vectors are one class, and a block sends on link
counts and a spanning forest, never its pairs.

The centroids are fitted on a bounded sample: the ``SAMPLE`` vectors with the
smallest hashes.  Everything else covers every row.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing; vectors of different dimensions do not
link; equal vectors link with one another; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import connected_components, drop_stage, session, stage

THRESHOLD = 0.9
SAMPLE = 16_384
#: residents of a block, visitors of a batch, and rows of one product
BLOCK, BATCH, ROWS = 2048, 16_384, 1024
MAX_CELLS = 4096
ROUNDS = 12
#: slack of the bounds against rounding
SLACK = 1e-6


def unit_rows(vectors: list) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; starts far apart (greedy) and is deterministic."""
    centroids = [sample[0]]
    nearest = sample @ sample[0]
    for _ in range(1, min(cells, len(sample))):
        centroids.append(sample[nearest.argmin()])
        nearest = np.maximum(nearest, sample @ centroids[-1])
    c = np.array(centroids)
    for _ in range(rounds):
        home = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def visited_cells(near: np.ndarray, home: np.ndarray, centroids: np.ndarray,
                  threshold: float) -> np.ndarray:
    """Which earlier cells each vector must visit (boolean, vector x cell)."""
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centroids @ centroids.T)))
    chord = math.sqrt(max(0.0, 2 - 2 * threshold))
    margin = near[np.arange(len(near)), home][:, None] - near
    ok = margin <= chord * apart[home] + SLACK
    return ok & (np.arange(len(centroids)) < home[:, None])


def _assign(centroids: np.ndarray, threshold: float):
    """(cid, copies, vector) -> the same with home cell and the cells to visit."""
    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            near = unit_rows(frame["vector"].tolist()) @ centroids.T
            home = near.argmax(axis=1)
            visits = visited_cells(near, home, centroids, threshold)
            yield frame.assign(home=home.astype(np.int32),
                               visits=[np.flatnonzero(v).astype(np.int32) for v in visits])
    return run


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph with edges (a, b) on ``size`` nodes."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def _compare(threshold: float):
    """One block's residents and one batch of its visitors -> counts and links."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cid, copies = frame["cid"].to_numpy(), frame["copies"].to_numpy(np.int64)
        guest = frame["guest"].to_numpy(bool)
        unit = unit_rows(frame["vector"].tolist())
        own, others = np.flatnonzero(~guest), np.flatnonzero(guest)
        links = np.zeros(len(frame), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []

        def block(rows: np.ndarray, columns: np.ndarray, within: bool) -> None:
            near = unit[rows] @ unit[columns].T >= threshold
            if within:
                near &= rows[:, None] < columns[None, :]
            if near.any():
                links[rows] += near @ copies[columns]
                links[columns] += copies[rows] @ near
                i, j = np.nonzero(near)
                a, b = _forest(rows[i], columns[j], len(frame))
                ends.append((cid[a], cid[b]))

        residents_too = bool(frame["first"].iloc[0])
        for at in range(0, len(own), ROWS):
            part = own[at:at + ROWS]
            if residents_too:
                block(part, own[at:], True)
            for there in range(0, len(others), ROWS):
                block(part, others[there:there + ROWS], False)
        some = np.flatnonzero(links)
        a = np.concatenate([e[0] for e in ends]) if ends else np.empty(0, np.int64)
        b = np.concatenate([e[1] for e in ends]) if ends else np.empty(0, np.int64)
        return pd.DataFrame({
            "a": np.concatenate((cid[some], a)),
            "b": pd.array(np.concatenate((cid[some], b)), dtype="Int64"),
            "links": pd.array([*links[some], *[None] * len(a)], dtype="Int64")})
    return run


def _linked(classes: DataFrame, threshold: float, cells: int | None, block: int) -> DataFrame:
    """(a, b, links): link counts (a = b) and spanning links of one dimension's classes."""
    n = classes.count()
    if cells is None:
        cells = max(1, min(MAX_CELLS, round(n / BLOCK)))
    sample = classes.orderBy(F.xxhash64("vector"), "cid").limit(SAMPLE).select("vector").collect()
    centroids = spherical_kmeans(unit_rows([r[0] for r in sample]), cells)
    homed = stage(classes.mapInPandas(
        _assign(centroids, threshold),
        "cid long, copies long, vector array<double>, home int, visits array<int>"), "homed")
    # blocks of a cell: rows of the cell over the block size
    size = {r["home"]: r["n"] for r in
            homed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {c: -(-k // block) for c, k in size.items()}
    per_cell = F.broadcast(homed.sparkSession.createDataFrame(
        [(c, k) for c, k in blocks.items()], "cell int, blocks int"))      # one row a cell
    mixed = F.xxhash64("cid")
    resident = homed.join(per_cell, F.col("home") == F.col("cell")).select(
        "cid", "copies", "vector", "visits", F.col("home").alias("cell"),
        F.pmod(mixed, F.col("blocks")).cast("int").alias("block"))
    # visits: blocks of earlier cells within reach, and earlier blocks of the own cell
    away = resident.select("cid", "copies", "vector", F.explode("visits").alias("to")).join(
        per_cell, F.col("to") == F.col("cell")).select(
        "cid", "copies", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        .alias("block"))
    home = resident.where("block > 0").select(
        "cid", "copies", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("block") - 1))
        .alias("block"))
    visits = away.unionByName(home)
    expected = visits.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "cell", "block", F.ceil(F.col("n") / BATCH).cast("int").alias("batches"))
    expected = stage(expected, "batches")
    guests = visits.join(expected.hint("broadcast") if expected.count() < 100_000 else expected,
                         ["cell", "block"]).select(
        "cell", "block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("batches")).cast("int")
        .alias("batch"), "cid", "copies", "vector", F.lit(True).alias("guest"))
    hosts = resident.join(expected, ["cell", "block"], "left").select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.greatest(
            F.coalesce("batches", F.lit(1)), F.lit(1)) - 1)).alias("batch"),
        "cid", "copies", "vector", F.lit(False).alias("guest"))
    rows = hosts.unionByName(guests).withColumn("first", F.col("batch") == 0)
    out = stage(rows.groupBy("cell", "block", "batch").applyInPandas(
        _compare(threshold), "a long, b long, links long"), "cosines")
    drop_stage(homed)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cells: int | None = None,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of (vec_id, embedding)."""
    spark = session(vectors)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("vector", lambda v: v != 0)
    valid = F.coalesce(finite & nonzero, F.lit(False))
    rows = stage(rows.withColumn("valid", valid).withColumn("hash", F.xxhash64("vector")), "vectors")
    classes = rows.where("valid").groupBy("hash", "vector").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for size in sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect()):
        part = _linked(classes.where(F.size("vector") == size).select("cid", "copies", "vector"),
                       threshold, cells, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = stage(connected_components(found.where("links is null").select("a", "b")), "components")
    named = classes.join(links, F.col("cid") == F.col("a"), "left").join(
        parts, F.col("cid") == F.col("node"), "left").select(
        "hash", "vector", "least",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component"))
    named = stage(named, "named")
    least = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    final = stage(named.join(least.hint("merge"), "component").select(
        F.col("hash").alias("h"), F.col("vector").alias("v"), "n_links", "component_id"), "final")
    met = rows.where("valid").join(final.hint("merge"), (F.col("hash") == F.col("h"))
                                   & (F.col("vector") == F.col("v")))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return met.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

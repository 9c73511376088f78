"""Near-duplicates of embeddings: a robust-pruned flat graph, built by shard, merged, and searched by range.

Equal vectors of a label are one node with a number of copies.  The nodes of a
label are split into cells by centres that are fitted on a bounded sample, level
by level, until a cell has at most ``PER_SHARD`` nodes.  A node's home is the
cell of its nearest centre; it is also put into each cell whose centre is so
little farther that a node linked to it may well have its home there: two unit
vectors at the threshold lie ``sqrt(2 - 2 SIMILARITY)`` apart, and ``SIGMAS``
times what that shifts the difference of two centres by, in a random direction,
is the margin.  So cells overlap, and a node meets what it links with at home.

Build: in each shard a node's candidates are its nearest ones and some drawn by
hash, and robust pruning keeps one only if no kept one is nearer to it by the
factor ``ALPHA``; some drawn from its range are added, as are edges backwards.  Merge: the adjacency lists that
a node got in its shards are united, as far as what they name is near enough to matter elsewhere; the rest of a list
serves the shard that made it only.  Search: from the medoids of its home, and
from its own list, each node walks greedily with a beam, then expands through
all it has met within the range and a slack, in the merged graph.  Neighbours
that the list of something found names but that live in other shards, and that
may be in range by the triangle inequality, are verified apart.  All links are
verified in double precision, counted where they are found and never sent in
pairs: a shard sends counts, and one edge a node for the components.

A cell that no centres can split, as its nodes lie too close together, is dealt
to blocks with a graph each, and its nodes search all of them.

Defined results: a vector that is null, empty or zero, or has a null, NaN or
infinite component, or a null label, links with nothing; vectors of different
lengths are never linked; equal vectors of a label are; rows that share an id
are vectors of their own; a component whose ids are all null has a null one, and
``kept`` compares null with null as equal; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, op2_minhash, textblock

SIMILARITY = 0.98
#: Nodes of a shard, about.
PER_SHARD = 8000
#: Centres of a split at most, and nodes that fit them, about.
CENTRES, SAMPLE = 64, 4000
SIGMAS = 3.0
#: A split that leaves this share of the nodes in one cell is given up.
STUCK = 0.8
#: Candidates by nearness and by hash, edges kept, edges to others of the range, edges after adding those backwards.
NEAR, DRAWN, DEGREE, RANGED, MOST = 40, 16, 24, 8, 64
ALPHA = 1.2
BEAM, MEDOIDS = 12, 8
#: The search goes on through what is at least so similar.
EXPAND = 0.95
#: Queries, and pairs of query and neighbour, that are held at once.
QUERIES, PAIRS = 250, 400_000

_ANGLE = float(np.arccos(SIMILARITY))
#: What an angle may be off by, as single precision holds it.
ROUNDED = 1e-5


# ---- geometry of one shard ----


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, also from numbers whose squares are out of range."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fitted(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of length one: spherical k-means from drawn rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and which centres it belongs to, that one included."""
    near = x @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    margin = SIGMAS * np.sqrt(2 - 2 * SIMILARITY) * apart[home] / np.sqrt(x.shape[1])
    return home, near[np.arange(len(x)), home][:, None] - near <= margin


def pruned(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of the candidates (rows of places in ``x``, padded with len(x) - 1) of each of ``own``: their places kept, padded."""
    pad = len(x) - 1
    sims = np.einsum("nd,nkd->nk", x[own], x[pool])
    sims[(pool == own[:, None]) | (pool == pad)] = -2
    order = np.argsort(-sims, 1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
    away = 2 - 2 * sims
    between = 2 - 2 * np.einsum("nkd,nld->nkl", x[pool], x[pool])
    covered = sims == -2
    kept = np.zeros_like(covered)
    for k in range(pool.shape[1]):
        take = ~covered[:, k] & (kept.sum(1) < degree)
        kept[:, k] = take
        covered |= take[:, None] & (ALPHA**2 * between[:, k, :] <= away)
        covered[:, k] = True
    out = np.full((len(own), degree), pad)
    at = np.cumsum(kept, 1) - 1
    r, c = np.nonzero(kept)
    out[r, at[r, c]] = pool[r, c]
    return out


def built(x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """The neighbours (places) of each row: pruned candidates, edges backwards added and pruned again where too many."""
    n = len(x)
    wide = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    out = np.full((n, DEGREE + RANGED), n)
    for i in range(0, n, 256):
        own = np.arange(i, min(i + 256, n))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -2
        k = min(NEAR, n - 1)
        pool = np.argpartition(-near, k - 1, 1)[:, :k] if k > 0 else np.full((len(own), 1), n)
        drawn = ((ids[own][:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DRAWN + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % n
        drawn[(drawn[:, :, None] == pool[:, None, :]).any(2)] = n
        for c in range(1, DRAWN):
            drawn[(drawn[:, c : c + 1] == drawn[:, :c]).any(1), c] = n
        out[own, :DEGREE] = pruned(wide, own, np.hstack([pool, drawn]), DEGREE)
        # in a group whose distances are all alike nothing is covered, and the nearest fill the list: some of the range keep it together
        mixed = (ids[own][:, None].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (ids[None, :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        chance = np.where(near >= EXPAND, textblock.mix(mixed) >> np.uint64(40), np.uint64(0))
        k = min(RANGED, n)
        best = np.argpartition(chance, n - k, 1)[:, n - k :]
        out[own, DEGREE : DEGREE + k] = np.where(np.take_along_axis(chance, best, 1) > 0, best, n)
    a, b = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    a, b = a[b < n], b[b < n]
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    lists = np.split(edges % n, np.searchsorted(edges, np.arange(1, n) * n))
    many = [i for i in range(n) if len(lists[i]) > MOST]
    for i in range(0, len(many), 64):
        own = np.array(many[i : i + 64])
        pool = np.full((len(own), max(len(lists[k]) for k in own)), n)
        for r, k in enumerate(own):
            pool[r, : len(lists[k])] = lists[k]
        # the nearest of them, as hubs can have very many
        near = np.einsum("nd,nkd->nk", x[own], wide[pool])
        near[pool == n] = -2
        best = np.argsort(-near, 1, kind="stable")[:, : 2 * MOST]
        for k, row in zip(own, pruned(wide, own, np.take_along_axis(pool, best, 1), MOST), strict=True):
            lists[k] = row[row < n]
    return lists


class Graph:
    """The nodes of a shard in order of their ids, with the neighbours that live in it and those that do not.

    ``own`` and ``place`` are edges inside the shard; ``owner``, ``others`` and ``angles`` those that other shards made.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, place: np.ndarray, owner: np.ndarray, others: np.ndarray, angles: np.ndarray) -> None:
        self.ids, self.exact = ids, unit(vectors)
        n = len(ids)
        self.x = np.vstack([self.exact, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        found = self.places(others)
        here = found < n
        own, place = np.divmod(np.unique(np.concatenate([own * n + place, owner[here] * n + found[here]])), n)
        sizes = np.bincount(own, minlength=n)
        self.near = np.full((n + 1, max(1, int(sizes.max(initial=0)))), n)
        self.near[own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = place
        order = np.argsort(owner[~here], kind="stable")
        self.away, self.angles = others[~here][order], angles[~here][order]
        self.cut = np.concatenate([[0], np.cumsum(np.bincount(owner[~here], minlength=n))])
        centres = fitted(self.x[:n], MEDOIDS, n)
        self.medoids = np.unique((self.x[:n] @ centres.T).argmax(0))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where the ids are in this shard; its size for those that are not."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, len(self.ids))

    def within(self, q: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, cosine) of what range-expanding greedy search finds; ``starts`` are places besides the medoids, padded."""
        n, m = len(self.ids), len(q)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def met(rows: np.ndarray, places: np.ndarray, sims: np.ndarray) -> None:
            on = sims >= EXPAND
            found.append((rows[on], places[on]))

        first = np.hstack([np.broadcast_to(self.medoids, (m, len(self.medoids))), starts])
        every = np.arange(m)
        sims = np.einsum("nd,nkd->nk", q, self.x[first])
        sims[seen[every[:, None], first]] = -2
        for c in range(first.shape[1]):  # a start may be a medoid
            sims[seen[every, first[:, c]], c] = -2
            seen[every, first[:, c]] = True
        met(np.repeat(every, first.shape[1]), first.ravel(), sims.ravel())
        places, done = first, sims == -2
        while True:
            order = np.argsort(-sims, 1, kind="stable")[:, :BEAM]
            places, sims, done = (np.take_along_axis(v, order, 1) for v in (places, sims, done))
            rows = np.flatnonzero((~done).any(1))
            if not len(rows):
                break
            pick = (~done[rows]).argmax(1)
            done[rows, pick] = True
            new = self.near[places[rows, pick]]
            s = np.einsum("nd,nkd->nk", q[rows], self.x[new])
            s[seen[rows[:, None], new]] = -2
            seen[rows[:, None], new] = True
            met(np.repeat(rows, new.shape[1]), new.ravel(), s.ravel())
            wide = [np.full((m, new.shape[1]), v, d) for v, d in ((n, int), (-2, np.float32), (True, bool))]
            wide[0][rows], wide[1][rows], wide[2][rows] = new, s, s == -2
            places, sims, done = (np.hstack([a, b]) for a, b in zip((places, sims, done), wide, strict=True))
        todo = [*found]
        step = max(1, PAIRS // self.near.shape[1])
        while todo:
            who, at = (np.concatenate(v) for v in zip(*todo, strict=True))
            todo = []
            for i in range(0, len(who), step):
                new = self.near[at[i : i + step]]
                rows = np.repeat(who[i : i + step], new.shape[1])
                new = new.ravel()
                fresh = ~seen[rows, new]
                code = np.unique(rows[fresh] * (n + 1) + new[fresh])
                rows, new = np.divmod(code, n + 1)
                seen[rows, new] = True
                s = np.einsum("nd,nd->n", q[rows], self.x[new])
                before = len(found)
                met(rows, new, s)
                todo += [v for v in found[before:] if len(v[0])]
        who, at = (np.concatenate(v) for v in zip(*found, strict=True))
        cos = np.concatenate([np.einsum("nd,nd->n", exact[who[i : i + PAIRS]], self.exact[at[i : i + PAIRS]]) for i in range(0, len(who), PAIRS)] or [np.zeros(0)])
        return who, at, cos


def labelled(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label that each place reaches by links (a, b) and by the labels it has."""
    own = np.arange(len(labels))
    a, b = np.concatenate([a, own]), np.concatenate([b, labels])
    while True:
        least = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


# ---- nodes, cells and shards ----


def prepared(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, part, key, vec): label and length, digest and bytes of each vector that can link, null for others."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, keys, vecs = [], [], []
        for label, v in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            x = None
            if label is not None and v.is_valid and len(v):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64) + 0  # no -0
                if v.values.null_count or not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else x.tobytes()
            part = None if x is None else f"{len(x)}:{label}"
            parts.append(part)
            vecs.append(raw)
            keys.append(None if x is None else hashlib.blake2b(f"{part}\n".encode() + raw, digest_size=16).digest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.string()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["row", "vec_id", "part", "key", "vec"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string"), "embedding")
    return common.map_batches(rows, run, "row long, vec_id long, part string, key binary, vec binary")


def _floats(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length from their bytes, in double precision."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * size else np.float64).reshape(-1, size).astype(np.float64)


def _size(cell: str) -> int:
    return int(cell.split(":", 1)[0])


def _streams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of the first two columns, rows) of sorted batches; of second value over 1 at most ``most`` rows at a time."""
    held: list = []
    now = None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        i = 0
        while i < len(a):
            j = i
            while j < len(a) and a[j] == a[i] and b[j] == b[i]:
                j += 1
            if now != (a[i], b[i]) or (now[1] > 1 and sum(x.num_rows for x in held) >= most):
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], (a[i], b[i])
            held.append(batch.slice(i, j - i))
            i = j
    if held:
        yield now, pa.Table.from_batches(held)


def centres_for(cells: DataFrame, big: DataFrame) -> DataFrame:
    """(cell, n, centres) of the cells (cell, n): centres fitted on a sample, null where they do not split the cell."""

    def run(table: pa.Table) -> pa.Table:
        cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
        order = np.argsort(table.column("node").to_numpy())
        x = unit(_floats(table.column("vec").combine_chunks(), _size(cell))[order]).astype(np.float32)
        centres = fitted(x, min(CENTRES, -(-2 * n // PER_SHARD)), n)
        _, inside = cells_of(x, centres)
        able = inside.mean(0).max() <= STUCK
        return pa.table({"cell": [cell], "n": pa.array([n], pa.int64()), "centres": pa.array([centres.tobytes() if able else None], pa.binary())})

    drawn = F.pmod(F.xxhash64("node", F.lit(12)), F.col("n")) < SAMPLE
    some = cells.join(big, "cell").filter(drawn).select("cell", "n", "node", "vec")
    return some.groupBy("cell").applyInArrow(run, "cell string, n long, centres binary")


def divided(cells: DataFrame, centres: DataFrame, salts: int) -> DataFrame:
    """``cells`` (cell, node, copies, home, vec) after the split of those with centres."""
    fields = "cell string, node long, copies long, home boolean, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for (cell, kind), rows in _streams(batches, 4 * QUERIES):
            if kind < 2:
                held = cell, np.frombuffer(rows.column("vec")[0].as_py(), np.float32).reshape(-1, _size(cell))
                continue
            rows = rows.select(["cell", "node", "copies", "home", "vec"]).combine_chunks()
            if held[0] == cell:
                x = unit(_floats(rows.column("vec").combine_chunks(), _size(cell))).astype(np.float32)
                nearest, inside = cells_of(x, held[1])
                who, into = np.nonzero(inside)
                home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)[who] & (nearest[who] == into)
                rows = rows.take(pa.array(who)).set_column(0, "cell", pa.array([f"{cell}/{k}" for k in into])).set_column(3, "home", pa.array(home))
            yield from rows.combine_chunks().to_batches()
        common.release()

    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt")
    members = cells.select("cell", F.lit(2).alias("kind"), salt, "node", "copies", "home", "vec")
    heads = centres.select("cell", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("boolean").alias("home"), F.col("centres").alias("vec"))
    dealt = heads.unionByName(members).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return dealt.select("cell", "kind", "node", "copies", "home", "vec").mapInArrow(run, fields)


def sharded(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (cell, node, copies, home, vec): nodes by cell, several for a node, one of them its home; and (cell, n) of cells that do not split."""
    cells = common.stored(nodes.select(F.col("part").alias("cell"), "node", "copies", F.lit(True).alias("home"), "vec"))
    dense = cells.sparkSession.createDataFrame([], "cell string, n long")
    salts, done = 256, []
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > PER_SHARD)
        big = common.stored(sizes)
        centres = common.stored(centres_for(cells, big))
        dense = dense.union(centres.filter("centres is null").select("cell", "n"))
        split = centres.filter("centres is not null")
        if not split.limit(1).count():
            return [*done, cells], dense
        # only what splits is dealt anew
        rest = common.stored(cells.join(split.select("cell"), "cell", "left_anti"))
        given, cells = cells, common.stored(divided(cells.join(split.select("cell"), "cell", "left_semi"), split, salts))
        common.dropped(given)
        done.append(rest)
        salts = max(1, salts // 16)


def _block(node: str, n: str):
    """The block of a node in a cell of ``n`` nodes that does not split (null: one that is no larger than a shard)."""
    return F.pmod(F.xxhash64(node, F.lit(7)), F.coalesce(F.ceil(F.col(n) / PER_SHARD), F.lit(1)).cast("int")).cast("int")


def placed(cells: DataFrame, dense: DataFrame) -> DataFrame:
    """``cells`` with shard and kind: 0 in the graph, 1 in the graph and a query, 2 a query of another block's graph."""
    blocks = F.coalesce(F.ceil(F.col("n") / PER_SHARD), F.lit(1)).cast("int")
    known = cells.join(dense, "cell", "left").withColumn("own", _block("node", "n")).withColumn("blocks", blocks)
    many = known.withColumn("block", F.explode(F.when(F.col("home") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    kind = F.when(F.col("block") != F.col("own"), 2).when(F.col("home"), 1).otherwise(0)
    here = F.xxhash64("cell")
    return many.select(F.concat_ws("#", here, "block").alias("shard"), kind.alias("kind"), here.alias("here"), F.regexp_extract("cell", "^[0-9]+", 0).cast("int").alias("size"), "node", "copies", "vec", "main", "into")


# ---- build, merge, search ----


def adjacency(shards: DataFrame, dense: DataFrame) -> DataFrame:
    """(shard, node, places, near, angles): the list that a node got in a shard, as places among the shard's sorted nodes, and what its other shards need of it.

    That is what is near enough to be in range of something that is in range of the node; a shard's own list has the rest of what lives there.
    """
    fields = "shard string, to long, node long, places binary, near binary, angles binary"

    def rows_of(shard: str | None, to: list, ids: np.ndarray, parts: tuple[list, list, list]) -> pa.RecordBatch:
        raw = [pa.array([v.tobytes() for v in part], pa.binary()) for part in parts]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.string()), pa.array(to, pa.int64()), pa.array(ids, pa.int64()), *raw], ["shard", "to", "node", "places", "near", "angles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _), rows in _streams(batches, 0):
            ids = rows.column("node").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            x = unit(_floats(rows.column("vec").combine_chunks(), rows.column("size")[0].as_py())[order])
            lists = built(x.astype(np.float32), ids)
            none = [np.zeros(0, np.int64)] * len(ids)
            yield rows_of(shard, [None] * len(ids), ids, ([v.astype(_places(len(ids))) for v in lists], none, none))
            own, near = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
            cos = np.concatenate([np.einsum("nd,nd->n", x[own[i : i + PAIRS]], x[near[i : i + PAIRS]]) for i in range(0, len(own), PAIRS)] or [np.zeros(0)])
            angles = np.arccos(np.clip(cos, -1, 1)).astype(np.float32)
            close = angles <= 2 * _ANGLE + 2 * ROUNDED
            own, near, angles = own[close], near[close], angles[close]
            into = rows.column("into").combine_chunks().take(pa.array(order))
            who = np.repeat(np.arange(len(ids)), into.value_lengths().to_numpy())
            cells, which = np.unique(into.flatten().to_numpy(), return_inverse=True)
            for k, cell in enumerate(cells.tolist()):
                if cell == rows.column("here")[0].as_py():
                    continue
                inside = np.zeros(len(ids), bool)
                inside[who[which == k]] = True
                some = np.flatnonzero(inside[own])
                if len(some):
                    nodes, first = np.unique(own[some], return_index=True)
                    cut = [np.split(v, first[1:]) for v in (ids[near[some]], angles[some])]
                    yield rows_of(None, [cell] * len(nodes), ids[nodes], ([v[:0] for v in cut[0]], *cut))
        common.release()

    inside = shards.filter("kind < 2").select("shard", F.lit(0).alias("kind"), "here", "size", "node", "vec", "into")
    lists = inside.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, fields)
    sizes = dense.select(F.xxhash64("cell").alias("to"), "n")
    named = F.coalesce("shard", F.concat_ws("#", "to", _block("node", "n")))
    return lists.join(sizes, "to", "left").select(named.alias("shard"), "node", "places", "near", "angles")


def _places(n: int) -> type:
    """The numbers that hold places among ``n`` nodes."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _edges(rows: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values in a column of their bytes."""
    raw = rows.column(column).to_pylist()
    size = np.dtype(kind).itemsize
    return np.repeat(np.arange(len(raw)), [len(v) // size for v in raw]), np.frombuffer(b"".join(raw), kind)


COUNT, EDGE, EXTRA = 0, 1, 2


def searched(shards: DataFrame, lists: DataFrame) -> DataFrame:
    """(what, a, b, n) of shards and their lists: links of a (n), links for the components, pairs for which a's home has no b."""

    def results(graph: Graph, info: pa.Table, labels: np.ndarray, rows: pa.Table) -> tuple[list, np.ndarray]:
        ids = rows.column("node").to_numpy()
        exact = unit(_floats(rows.column("vec").combine_chunks(), graph.exact.shape[1]))
        # a node of the graph starts from its list too
        starts = graph.near[graph.places(ids)]
        who, at, cos = graph.within(exact.astype(np.float32), starts, exact)
        own = graph.ids[at] == ids[who]
        linked = (cos >= SIMILARITY) & ~own
        w, t = who[linked], at[linked]
        out = []
        counts = np.bincount(w, weights=info["copies"][t], minlength=len(ids)).astype(np.int64)
        some = np.flatnonzero(counts)
        out.append((np.full(len(some), COUNT), ids[some], np.zeros(len(some), np.int64), counts[some]))
        # queries stand behind the nodes of the graph, unless they are among them
        n, place = len(graph.ids), graph.places(ids)
        place = np.where(place < n, place, n + np.arange(len(ids)))
        every = labelled(np.concatenate([labels, n + np.arange(len(ids))]), place[w], t)
        guests = np.flatnonzero((place >= n) & (every[place] < n))
        out.append((np.full(len(guests), EDGE), ids[guests], graph.ids[every[place[guests]]], np.zeros(len(guests), np.int64)))
        # what is linked here but does not meet the query in its own home
        inside = [set(v) for v in rows.column("into").to_pylist()]
        foreign = np.flatnonzero(info["main"][t] != info["here"])
        lost = [(graph.ids[t[k]], ids[w[k]]) for k in foreign if info["main"][t[k]] not in inside[w[k]]]
        # neighbours of what was found that live elsewhere
        found = np.flatnonzero(linked | own)
        f, p = who[found], at[found]
        sizes = graph.cut[p + 1] - graph.cut[p]
        k = np.repeat(np.arange(len(f)), sizes)
        edge = np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + graph.cut[p][k]
        angle = np.arccos(np.clip(cos[found], -1, 1))[k]
        may = np.flatnonzero(np.abs(graph.angles[edge] - angle) <= _ANGLE + ROUNDED)
        pairs = {(ids[f[k[m]]], graph.away[edge[m]]) for m in may}
        extra = np.array(sorted({(int(a), int(b)) for a, b in [*lost, *pairs] if a != b}), np.int64).reshape(-1, 2)
        out.append((np.full(len(extra), EXTRA), extra[:, 0], extra[:, 1], np.zeros(len(extra), np.int64)))
        return out, every[:n]

    def batches_of(out: list) -> Iterator[pa.RecordBatch]:
        what, a, b, n = (np.concatenate(v) for v in zip(*out, strict=True))
        if len(what):
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["what", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph, info, labels, lists = None, None, {}, None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if graph is not None:
                tied = np.flatnonzero(labels != np.arange(len(labels)))
                zero = np.zeros(len(tied), np.int64)
                yield from batches_of([(np.full(len(tied), EDGE), graph.ids[tied], graph.ids[labels[tied]], zero)])

        for (shard, kind), rows in _streams(batches, QUERIES):
            if shard != now:
                yield from ended()
                now, graph, lists = shard, None, None
            if kind == 0:
                lists = rows
            elif kind == 1:
                rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy())))
                ids = rows.column("node").to_numpy()
                place = np.searchsorted(ids, lists.column("node").to_numpy())
                own, at = _edges(lists, "places", _places(len(ids)))
                owner, others = _edges(lists, "near", np.int64)
                graph = Graph(ids, _floats(rows.column("vec").combine_chunks(), rows.column("size")[0].as_py()), place[own], at.astype(np.int64), place[owner], others, _edges(lists, "angles", np.float32)[1])
                info = {c: rows.column(c).to_numpy() for c in ("copies", "main")} | {"here": rows.column("here")[0].as_py()}
                labels = np.arange(len(ids))
                asked = rows.filter(rows.column("ask"))
                parts = [asked.slice(i, QUERIES) for i in range(0, asked.num_rows, QUERIES)]
            else:
                parts = [rows] if graph is not None else []
            for part in parts if kind else []:
                out, labels = results(graph, info, labels, part)
                yield from batches_of(out)
        yield from ended()
        common.release()

    rows = shards.select("shard", F.when(F.col("kind") < 2, 1).otherwise(2).alias("kind"), (F.col("kind") > 0).alias("ask"), "here", "size", "node", "copies", "vec", "main", "into")
    dealt = rows.unionByName(lists.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return dealt.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "what int, a long, b long, n long")


def verified(extra: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, n) of pairs in range of which a's home has no b, in both directions; n is how many copies b has."""
    both = extra.select("a", "b").union(extra.select("b", "a")).distinct()
    asked = both.join(cells.filter("home").select(F.col("node").alias("a"), F.col("main").alias("here")), "a")
    asked = asked.join(cells.select(F.xxhash64("cell").alias("here"), F.col("node").alias("b")), ["here", "b"], "left_anti")
    own = cells.filter("home").select("node", "copies", "vec", F.regexp_extract("cell", "^[0-9]+", 0).cast("int").alias("size"))
    left = own.select(F.col("node").alias("a"), F.col("vec").alias("u"), "size")
    right = own.select(F.col("node").alias("b"), F.col("vec").alias("v"), F.col("copies").alias("n"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        on = []
        for k, (u, v, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
            x, y = (unit(_floats(pa.array([w], pa.binary()), size))[0] for w in (u, v))
            if x @ y >= SIMILARITY:
                on.append(k)
        return batch.take(pa.array(on, pa.int64())).select(["a", "b", "n"]) if on else None

    return common.map_batches(asked.join(left, "a").join(right, "b").select("a", "b", "n", "u", "v", "size"), run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    return common.only(lambda: _near_duplicates(vectors))


def _near_duplicates(vectors: DataFrame) -> DataFrame:
    # vectors are kept once, and in the tables of cells; what a step has read goes with it
    rows = common.stored(prepared(vectors))
    named = common.stored(rows.select("vec_id", "key"))
    whole = common.stored(rows.filter("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("part").alias("part"), F.first("vec").alias("vec")))
    common.dropped(rows)
    nodes = common.stored(whole.select("key", "node", "vec_id", "copies"))
    parts, dense = sharded(whole)
    common.dropped(whole)
    given, hashed = functools.reduce(DataFrame.unionByName, parts), F.xxhash64("cell")
    homes = common.stored(given.groupBy("node").agg(F.collect_list(hashed).alias("into"), F.max(F.when(F.col("home"), hashed)).alias("main")))
    cells = common.stored(given.join(homes, "node"))
    for at in parts:
        common.dropped(at)
    common.dropped(homes)
    shards = placed(cells, dense)
    lists = common.stored(adjacency(shards, dense))
    found = common.stored(searched(shards, lists))
    common.dropped(lists)
    extra = common.stored(verified(found.filter(F.col("what") == EXTRA), cells))
    common.dropped(cells)
    counts = found.filter(F.col("what") == COUNT).select("a", "n").union(extra.select("a", "n")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    edges = common.stored(found.filter(F.col("what") == EDGE).select("a", "b").union(extra.select("a", "b")))
    # components() passes labels on, so it sees no node without links
    labels = op2_minhash.components(edges) if edges.limit(1).count() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    known = nodes.select("key", "node", "vec_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = common.stored(known)
    least = known.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    each = known.join(least, "label").join(counts, "node", "left").select(F.col("key").alias("own"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = named.join(each, F.col("key") == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def audited(vectors: DataFrame, found: DataFrame) -> tuple[int, int]:
    """Links of vectors whose id is divisible by 50 as all rows have them, by comparing blocks, and as ``found`` has them."""
    rows = common.stored(prepared(vectors).filter("key is not null"))
    asked = rows.filter("vec_id % 50 = 0").select(F.pmod(F.xxhash64("row"), F.lit(common.parts_for(rows.count(), 50 * QUERIES))).alias("block"), F.lit(0).alias("kind"), "part", "row", "vec", "vec_id")
    blocks = asked.select("block").distinct()
    every = rows.crossJoin(F.broadcast(blocks)).select("block", F.lit(2).alias("kind"), "part", "row", "vec", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for (_, kind), table in _streams(batches, 4 * QUERIES):
            sizes = {}
            for part in set(table.column("part").to_pylist()):
                some = table.filter(pa.compute.equal(table.column("part"), part))
                sizes[part] = some.column("row").to_numpy(), unit(_floats(some.column("vec").combine_chunks(), _size(part)))
            if kind == 0:
                held = sizes
                continue
            for part, (ids, x) in sizes.items():
                if part in held:
                    own, y = held[part]
                    n = ((y @ x.T >= SIMILARITY) & (own[:, None] != ids[None, :])).sum()
                    yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int64())], ["n"])

    salt = F.pmod(F.xxhash64("row"), F.lit(16)).alias("salt")
    dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).unionByName(every.withColumn("salt", salt.cast("int")))
    dealt = dealt.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").select(F.concat_ws("/", "block", "salt"), "kind", "part", "row", "vec")
    truth = dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    return truth, found.filter("vec_id % 50 = 0").agg(F.sum("n_links")).first()[0] or 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v
  FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM vectors a JOIN vectors b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98
), reached AS (
  SELECT r AS a, r AS b FROM vectors
  UNION
  SELECT x.a, l.b FROM reached x JOIN links l ON l.a = x.b
), components AS (
  SELECT x.a, min(v.vec_id) AS component_id FROM reached x JOIN vectors v ON v.r = x.b GROUP BY x.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.r) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors v JOIN components c ON c.a = v.r
"""

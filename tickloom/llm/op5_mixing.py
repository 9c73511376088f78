"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of each source form one stream, its documents in seeded order, cut
into blocks of ``BLOCK`` words.  Targets are shares of the weights, filled up
to a cap on repeats.  Sainte-Lague gives blocks to sources by highest
quotients target / (2 quota + 1); its seats are house-monotone, so the quotas
of output shard k are the seats after (k + 1) / shards of all blocks less
those after k / shards.  Seats for any house come from a search for the
divisor, whatever the number of blocks.

Occurrence o of a source (0 <= o < quota) is pass o // blocks over its stream
from a seeded first block on, so block j is taken in pass p where
p * blocks + (j - first) mod blocks < quota.  The words taken of a document
are then interval overlaps: plain arithmetic on its place in the stream, which
is a prefix sum by (source, hash bucket) and never a sort of a whole source.

``spans`` gives the mix itself: which words of which document go into which
shard in which pass; ``mix`` sums them up, and ``whole_documents`` takes a
document as often as the mix takes most of its words, row by row: equal rows
follow each other in the stream, and as many of them are taken as it says.

Up to ``SOURCES`` sources are apportioned on the driver, more by sums over a
table of the sources: the water level of the targets, the divisor of each house
and the last of equal quotients are all found by a few passes that return sums.

Defined results: a null text has no words; a null source is a source of its
own, the last; the place of a row in its stream comes from its id and text, so
null or equal ids do not gather, and equal rows follow each other; texts of any
length are counted whole; an empty table gives no rows; other columns are not
read, but ``whole_documents`` passes them on.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words in a block.
BLOCK = 32
PER_BUCKET = 4_000
SEED = 20_240_229
SHARDS = 16
#: Sources that the driver apportions among; more are apportioned where they are.
SOURCES = 100_000
#: Points between which a pass over the sources narrows down a divisor or a rank.
POINTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words due to each source: shares of ``share`` times all sizes by weight, none above
    ``most`` times its size; the excess goes to the others by weight until none is above."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if total * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = total * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
            total -= out[i]
        gone = set(above)
        free = [i for i in free if i not in gone]
    return out


def seats(due: list[float], caps: list[int], house: int) -> list[int]:
    """Sainte-Lague seats: ``house`` of them to the highest quotients due / (2 s + 1), s below the cap.

    The divisor search finds the seats that are certain; the last few go one by one, ties to the earlier.
    """
    d, c = np.array(due, float), np.array(caps, np.int64)
    house = min(house, int(c[d > 0].sum()))

    def at(x: float) -> np.ndarray:
        return np.where(d > 0, np.minimum(c, np.minimum(d * x + 0.5, 2.0**62).astype(np.int64)), 0)

    low, high = 0.0, 1.0
    while at(high).sum() < house:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() <= house:
            low = mid
        else:
            high = mid
    got = at(low * (1 - 1e-9)).tolist()  # a little less, so that ties are left to the quotients
    heap = [(-due[i] / (2 * got[i] + 1), i) for i in range(len(due)) if due[i] > 0 and got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(house - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-due[i] / (2 * got[i] + 1), i))
    return got


def plan(sizes: list[int], weights: list[float], shards: int = SHARDS, block: int = BLOCK) -> dict:
    """Targets, blocks, quotas, and the running quotas of each source by shard."""
    due = targets(sizes, weights)
    blocks = [-(-s // block) for s in sizes]
    caps = [2 * b for b in blocks]
    house = round(sum(due) / block)
    running = [[0] * len(sizes)]
    for k in range(1, shards + 1):
        now = seats(due, caps, house * k // shards)
        running.append([max(a, b) for a, b in zip(running[-1], now, strict=True)])
    return {"targets": due, "blocks": blocks, "quotas": running[-1], "running": [list(x) for x in zip(*running, strict=True)]}


# ---- many sources ----


def summed(rows: DataFrame, fn: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum of ``fn`` over the columns of all batches of numbers; only sums leave the tasks."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = fn({c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)})
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.astype(float))], ["k", "v"])

    found = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(found))
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def _at(due: np.ndarray, cap: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Seats of each source (rows) at each divisor (columns)."""
    return np.minimum(cap[:, None], np.floor(due[:, None] * x[None, :] + 0.5)).astype(np.int64)


def ranked_sources(found: DataFrame) -> DataFrame:
    """(source, words, rank) in order of code points, null last: places within sorted partitions, and how many are before."""
    placed = common.stored(found.select("source", "words").orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(F.shiftright("id", 33).alias("part")).count().collect())  # a row a partition
    before, first = 0, []
    for part, n in sizes:
        first.append((part, before))
        before += n
    parts = F.broadcast(found.sparkSession.createDataFrame(first, "part long, first long"))
    return placed.join(parts, F.shiftright("id", 33) == F.col("part")).select("source", "words", (F.col("first") + F.expr("id & ((1L << 33) - 1)")).alias("rank"))


def planned(found: DataFrame, seed: int, shards: int, block: int, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``plan`` for (source, words) of any number of sources, as a table of one row a source."""
    rows = common.stored(ranked_sources(found).withColumn("weight", F.expr("element_at(array(3.0D, 1.0D, 2.0D), CAST(rank % 3 + 1 AS INT))")))
    facts = rows.select("words", "weight", "rank")
    total = share * summed(facts, lambda c: np.array([c["words"].sum()]))[0]
    # a source is at its cap where that, by weight, is under the level, which only rises
    level, full = 0.0, -1.0
    while True:
        capped, free, n = summed(facts, lambda c: np.array([(most * c["words"])[(on := most * c["words"] / c["weight"] < level)].sum(), c["weight"][~on].sum(), on.sum()]))  # noqa: B023
        if n <= full or not free:
            break
        level, full = (total - capped) / free, n

    def known(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        due = np.minimum(most * c["words"], level * c["weight"]) if free else most * c["words"].astype(float)
        return due, np.where(due > 0, 2 * -(-c["words"] // block), 0)

    def seats_at(x: np.ndarray) -> np.ndarray:
        return summed(facts, lambda c: _at(*known(c), x).sum(0))

    sums = summed(facts, lambda c: np.array([x.sum() for x in known(c)]))
    house = round(float(sums[0]) / block)
    wanted = np.array([min(house * k // shards, int(sums[1])) for k in range(1, shards + 1)])
    powers = 2.0 ** np.arange(-62, 63)
    held = seats_at(powers)
    high = powers[np.minimum(np.searchsorted(held, wanted, "right"), len(powers) - 1)]
    low = np.where(high > powers[0], high / 2, 0.0)
    for _ in range(10):
        grid = low + (high - low) * np.arange(1, POINTS + 1)[:, None] / (POINTS + 1)
        under = seats_at(grid.ravel()).reshape(POINTS, shards) <= wanted
        n = under.sum(0)
        every = np.vstack([low, grid, high])
        low, high = every[n, np.arange(shards)], every[n + 1, np.arange(shards)]
    low = low * (1 - 1e-12)  # ties are left to the quotients
    rest = wanted - seats_at(low)

    def open_quotients(c: dict[str, np.ndarray], k: int) -> np.ndarray:
        due, cap = known(c)
        got = _at(due, cap, low[k : k + 1])[:, 0]
        return np.where((due > 0) & (got < cap), due / (2 * got + 1), -1.0)

    # the last seats of a house: all quotients over a bound, and of those equal to it the first ranks
    bound, last = np.full(shards, np.inf), np.full(shards, -1)
    short = [int(k) for k in np.flatnonzero(rest > 0)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_numpy() for i, n in enumerate(("words", "weight", "rank"))}
            for k in short:
                q = open_quotients(c, k)
                q = q[2 * q * low[k] * (1 + 1e-9) >= 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), k)), pa.array(q)], ["k", "q"])

    # quotients of so narrow a range are few, however many sources have them
    values = sorted(((r["k"], -r["q"], r["count"]) for r in facts.mapInArrow(near, "k long, q double").groupBy("k", "q").count().collect())) if short else []
    left = rest.copy()
    for k, q, n in values:
        if left[k] > 0:
            bound[k] = -q
            last[k] = left[k]  # for now how many of those equal to the bound
            left[k] -= n
    need = last.copy()
    count = rows.count()
    a, b = np.full(shards, -1), np.full(shards, count - 1)  # fewer than needed up to a, enough up to b
    while short and (b - a)[short].max() > 1:
        points = a[:, None] + ((b - a)[:, None] * np.arange(1, POINTS + 1)[None, :]) // (POINTS + 1)

        def upto(c: dict[str, np.ndarray], points: np.ndarray = points) -> np.ndarray:
            return np.concatenate([((open_quotients(c, k) == bound[k])[:, None] & (c["rank"][:, None] <= points[k][None, :])).sum(0) for k in short])

        found_at = summed(facts, upto).reshape(len(short), POINTS)
        for k, own in zip(short, found_at, strict=True):
            n = int((own < need[k]).sum())
            a[k], b[k] = points[k][n - 1] if n else a[k], points[k][n] if n < POINTS else b[k]
    last[short] = b[short]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(("words", "weight", "rank"), 1)}
        due, cap = known(c)
        running = _at(due, cap, low)
        for k in range(shards):
            q = open_quotients(c, k)
            running[:, k] += (q > bound[k]) | ((q == bound[k]) & (c["rank"] <= last[k]))
        running = np.maximum.accumulate(np.hstack([np.zeros((len(due), 1), np.int64), running]), 1)
        blocks = -(-c["words"] // block)
        start = [first_block(s, int(n), seed) for s, n in zip(batch.column(0).to_pylist(), blocks, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(due), pa.array(blocks), pa.array(running[:, -1]), pa.array(start, pa.int64()), pa.array(running.tolist(), pa.list_(pa.int64()))], FACTS.replace("array<long>", "").replace(" long", "").replace(" double", "").replace(" string", "").replace(" ", "").split(","))

    return common.stored(common.map_batches(rows.select("source", "words", "weight", "rank"), run, FACTS))


FACTS = "s string, source_size long, target double, blocks long, quota long, start long, running array<long>"


def counted(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, h, source, size) with the words of each whole text; h orders the stream of its source."""
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("h")
    return docs.select(F.col("doc_id").cast("long"), place, F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def first_block(source: str | None, blocks: int, seed: int) -> int:
    word = f"{seed}:{'n' if source is None else 's' + source}".encode()
    return int.from_bytes(hashlib.sha256(word).digest()[:8], "big") % max(1, blocks)


def placed_documents(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Documents in the streams of their sources, with what the mix takes of each."""
    spark = docs.sparkSession
    rows = common.stored(counted(docs, seed))
    each = rows.groupBy("source").agg(F.sum("size").alias("words"))
    found = each.limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        sources = planned(each, seed, shards, block)
    else:
        sums = sorted(((x["source"], x["words"]) for x in found), key=lambda x: (x[0] is None, x[0]))
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sums))]
        p = plan([x[1] for x in sums], weights, shards, block)
        facts = [(s, w, p["targets"][i], p["blocks"][i], p["quotas"][i], first_block(s, p["blocks"][i], seed), p["running"][i]) for i, (s, w) in enumerate(sums)]
        sources = spark.createDataFrame(facts, FACTS)
    bits = max(0, (common.parts_for(rows.count(), PER_BUCKET) - 1).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # the order of the stream is that of h as an unsigned number: bucket first, then its low bits
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    own = Window.partitionBy("source", "bucket").orderBy(order, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    placed = rows.withColumn("upto", F.sum("size").over(own)).join(first, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1")))
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("a", F.col("first") + F.col("upto") - F.col("size")).withColumn("b", F.col("a") + F.col("size"))
    n, q, st = F.col("blocks"), F.col("quota"), F.col("start")
    placed = placed.withColumn("passes", F.when(n > 0, F.floor(q / F.greatest(n, F.lit(1)))).otherwise(0)).withColumn("run", q - F.col("passes") * n)

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo))

    extra = overlap(st * block, F.least(st + F.col("run"), n) * block) + overlap(F.lit(0), (st + F.col("run") - n) * block)
    occurrence = F.pmod(F.floor(F.col("a") / block) - st, F.greatest(n, F.lit(1)))
    return placed.withColumn("extra", extra).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long")).withColumn("occurrence", F.when((F.col("taken") > 0) & (occurrence < q), occurrence))


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """One row per document: what the mix takes of it, and the first shard that takes any."""
    shard = F.size(F.filter("running", lambda x: x <= F.col("occurrence"))) - 1
    return placed_documents(docs, seed, shards, block).select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("occurrence").isNotNull(), shard).alias("first_shard"))


def spans(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, pass, shard, first, last): the words of each document that the mix takes, numbered from 0, ``last`` excluded.

    A block's occurrence in a pass says in which shard it goes; neighbouring blocks of
    one shard are one span.  A document and its h name its row; the words are those of ``WORD``.
    """
    n, q, st = F.col("blocks"), F.col("quota"), F.col("start")
    placed = placed_documents(docs, seed, shards, block).filter("size > 0")
    # in pass p the blocks whose occurrence p * blocks + (j - start) mod blocks is below the quota
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((q - 1) / n))).alias("pass")
    each = placed.filter(q > 0).select("*", passes)
    # within a pass a shard's occurrences are one run of offsets from the start block, which the end of the stream may cut in two
    def parts(k):
        o1 = F.greatest(F.element_at("running", k + 1) - F.col("pass") * n, F.lit(0))
        o2 = F.least(F.element_at("running", k + 2) - F.col("pass") * n, n)
        ends = [(st + o1, F.least(st + o2, n)), (F.greatest(st + o1 - n, F.lit(0)), st + o2 - n)]
        return F.array(*[F.struct(k.alias("shard"), F.greatest(lo * block, "a").alias("lo"), F.least(hi * block, "b").alias("hi"), (o1 < o2).alias("some")) for lo, hi in ends])

    # only what a document has in a shard becomes a row
    met = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), parts)), lambda x: x["some"] & (x["lo"] < x["hi"]))
    cut = each.select("doc_id", "h", "a", "pass", F.explode(met).alias("part")).select("*", "part.*")
    return cut.select("doc_id", "h", F.col("pass").cast("int"), "shard", (F.col("lo") - F.col("a")).alias("first"), (F.col("hi") - F.col("a")).alias("last"))


def whole_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents as often as the mix takes most of their words, whole: never, once or twice.

    In the seeded order of a source the documents of its last pass are one run, cyclically, so
    a row for each source says which hashes are in it, and no text is moved to learn it.
    """
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    chosen = F.col("extra") * 2 >= F.col("size")
    seen = common.stored(placed_documents(docs, seed).filter("size > 0").select(F.col("source").alias("__source"), "passes", order.alias("__o"), chosen.alias("chosen")))
    runs = common.stored(seen.groupBy("__source").agg(F.first("passes").alias("__passes"), *[F.expr(f"{f}(__o) FILTER (WHERE {c})").alias(f"__{f}_{k}") for f in ("min", "max") for c, k in (("chosen", "in"), ("NOT chosen", "out"))]))
    same = F.col("source").cast("string").eqNullSafe(F.col("__source"))
    # equal rows follow each other, so only where a run begins or ends some are chosen and others not
    edge = F.col("__o").isin(*[F.col(f"__{f}_{k}") for f in ("min", "max") for k in ("in", "out")])
    met = seen.withColumnRenamed("__source", "source").join(runs, same).filter(edge)
    split = common.stored(met.groupBy("__source", "__o").agg(F.count_if("chosen").alias("__some"), F.count("*").alias("__n")).filter("__some > 0 AND __some < __n").drop("__n"))
    # the run lies inside the others, or, where it goes round the end, the others lie inside it
    wraps = (F.col("__min_in") < F.col("__min_out")) & (F.col("__max_in") > F.col("__max_out"))
    o = F.col("__at")
    inside = F.when(F.col("__min_in").isNull(), False).when(F.col("__min_out").isNull(), True).when(wraps, ~o.between(F.col("__min_out"), F.col("__max_out"))).otherwise(o.between(F.col("__min_in"), F.col("__max_in")))
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).bitwiseXOR(F.lit(-(2**63))).alias("__at")
    able = docs.filter(F.col("text").rlike(WORD)).select("*", place)
    many = split.limit(1).count()
    apart = split.select(F.col("__source").alias("__s"), F.col("__o"), "__some")
    match = F.col("source").cast("string").eqNullSafe(F.col("__s")) & (o == F.col("__o"))
    rest = able.join(apart, match, "left_anti") if many else able
    out = rest.join(runs, same).withColumn("__times", F.col("__passes").cast("int") + inside.cast("int"))
    if many:
        # which of the equal rows go is all one; they are numbered by the split they are read in
        odd = common.stored(able.join(apart, match).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
        before = Window.partitionBy("__s", "__o").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        first = odd.groupBy("__s", "__o", "__part").agg(F.count("*").alias("__c")).select(F.col("__s").alias("__s2"), F.col("__o").alias("__o2"), F.col("__part").alias("__part2"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first"))
        own = F.row_number().over(Window.partitionBy("__s", "__o", "__part").orderBy("__id"))
        numbered = odd.withColumn("__own", own).join(first, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__o") == F.col("__o2")) & (F.col("__part") == F.col("__part2")))
        taken = (F.col("__first") + F.col("__own") <= F.col("__some")).cast("int")
        out = out.select(*common.columns(docs), "__times").unionByName(numbered.join(runs, same).withColumn("__times", F.col("__passes").cast("int") + taken).select(*common.columns(docs), "__times"))
    out = out.filter(F.col("__times") > 0).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*common.columns(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as whole documents, with all their columns; the cases are those of the module."""
    common.session(spark)
    return whole_documents(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))

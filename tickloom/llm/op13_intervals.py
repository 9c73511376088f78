"""Interval overlap join by nested containment lists, summed by relation.

Two sets of intervals with a key each, ends inclusive, an end of ``OPEN`` for
those without one.  Intervals of a key are put into nested containment lists:
in order of (start, longer first) an interval goes below the last one before it
that ends later, so in each list both starts and ends rise, what overlaps is
found by binary search, and the search descends from what it has found.
Intervals without an end, which end alike, form the outermost list.  All lists
of one depth lie one after another, so the sublists of neighbouring containers
are one range; where ends go on rising over their borders they are searched as
one.  Matches of a list are told apart by relation with four more searches, and
running sums give their number, shared slots and digests: no pair is made.

A shard holds the lists of many keys, those of a key lying ``STRIDE`` apart from
the next one's.  A key with many queries is dealt to several shards, each with
the key's lists.  What a key holds is summed up before: sessions are built from
cells of 15 minutes (the first and last click of each) by day, with a row a day to
join them over midnight, and sessions that take the same slots are one interval
with a number and a sum.  So the rows of a key are bounded by the length of the
period and not by its clicks.

Defined results: rows with a null key or start, intervals that end before they
start and null line times are left out; a status or kind that is null is not
open; rows of sales that share a sale_id are sales of their own, whose sums are
added; ``overlap_slots`` leaves out pairs that are open on both sides and is null
where there are no others; a sale that meets no session has no row; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GAP = 15 * 60 * 1_000_000
SLOT = 6 * 3600 * 1_000_000
#: Cells of the length of the gap in a day.
PER_DAY = 96
#: The end of an interval that has none.
OPEN = 1 << 40
#: Rows of a shard, about.
PER_SHARD = 50_000
#: A key with more than this share of the queries is dealt to several shards; so there are at most as many such keys.
SHARES = 65_536
#: Rows that are searched at once.
AT_ONCE = 20_000

_HALF = 1 << 41
_STRIDE = 1 << 42

#: By where a query starts (later, equally, earlier), and in each case where it ends (later, equally, earlier).
RELATIONS = ["overlapped_by", "finishes", "during", "started_by", "equals", "starts", "contains", "finished_by", "overlaps"]


def bisect(values: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """For each query, where ``at`` goes in the rising ``values[low:high]``, before or behind what equals it."""
    low, high = low.copy(), high.copy()
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) >> 1
        up = values[mid] <= at[busy] if right else values[mid] < at[busy]
        low[busy[up]] = mid[up] + 1
        high[busy[~up]] = mid[~up]
    return low


class Level:
    """All lists of one depth, one after another, and where the lists below each interval begin."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray, total: np.ndarray, base: np.ndarray) -> None:
        self.first, self.last = first, last
        self.run = np.concatenate([[0], np.cumsum(last[1:] < last[:-1])])
        self.borders = np.flatnonzero(np.diff(self.run, prepend=-1))
        ends = np.where(last - base == OPEN, 0, last - base)
        self.sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, total, n * (first - base), n * ends)]
        self.below = np.zeros(len(first) + 1, np.int64)


class Lists:
    """Nested containment lists of intervals (first, last) that stand for ``n`` each and add ``total`` to a sum."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray, total: np.ndarray, base: np.ndarray) -> None:
        order = np.lexsort((-last, first))
        first, last, n, total, base = (x[order] for x in (first, last, n, total, base))
        depth = np.empty(len(first), np.int64)
        above = np.full(len(first), -1, np.int64)
        ends = last.tolist()
        around: list[int] = []
        for i, end in enumerate(ends):
            while around and ends[around[-1]] <= end:
                around.pop()
            depth[i] = len(around)
            if around:
                above[i] = around[-1]
            around.append(i)
        self.levels: list[Level] = []
        place = np.empty(len(first), np.int64)
        for d in range(int(depth.max()) + 1 if len(depth) else 0):
            here = np.flatnonzero(depth == d)
            place[here] = np.arange(len(here))
            if d:
                upper = self.levels[-1]
                upper.below = np.searchsorted(place[above[here]], np.arange(len(upper.below)))
            self.levels.append(Level(first[here], last[here], n[here], total[here], base[here]))

    def related(self, a: np.ndarray, b: np.ndarray, base: np.ndarray) -> np.ndarray:
        """(queries, relations, 3): number, shared slots and sum of totals of what each [a, b] meets."""
        out = np.zeros((len(a), len(RELATIONS), 3), np.int64)
        who = np.arange(len(a))
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(self.levels[0].first) if self.levels else 0)
        for level in self.levels:
            # a range that spans several runs is searched in each of them
            runs = level.run[np.maximum(high - 1, low)] - level.run[low] + 1 if len(low) else low
            at = np.repeat(np.arange(len(who)), runs)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(runs) - runs, runs)
            run = level.run[low[at]] + nth
            lo = np.maximum(low[at], level.borders[run])
            hi = np.minimum(high[at], np.append(level.borders[1:], len(level.first))[run])
            who, x, y, off = who[at], a[who[at]], b[who[at]], base[who[at]]
            begin, end = bisect(level.last, x, lo, hi, False), bisect(level.first, y, lo, hi, True)
            end = np.maximum(begin, end)
            starts = [begin, bisect(level.first, x, begin, end, False), bisect(level.first, x, begin, end, True), end]
            stops = [begin, bisect(level.last, y, begin, end, False), bisect(level.last, y, begin, end, True), end]
            x, y = x - off, y - off
            for i in range(3):
                for j in range(3):
                    p = np.maximum(starts[i], stops[j])
                    q = np.maximum(p, np.minimum(starts[i + 1], stops[j + 1]))
                    n, total, firsts, lasts = (s[q] - s[p] for s in level.sums)
                    shared = (lasts if j == 0 else n * y) - (firsts if i == 2 else n * x) + n
                    if j == 1:
                        shared[y == OPEN] = 0
                    some = np.flatnonzero(n)
                    np.add.at(out, (who[some], 3 * i + j), np.stack([n, shared, total], 1)[some])
            on = np.flatnonzero((level.below[end] > level.below[begin]) & (end > begin))
            who, low, high = who[on], level.below[begin[on]], level.below[end[on]]
            if not len(who):
                break
        return out


class Shard:
    """The lists of the keys of a shard, and the search for queries of these keys."""

    def __init__(self, rows: pa.Table) -> None:
        key, salt, first, last, n, total = (rows.column(c).to_numpy() for c in ("key", "salt", "first", "last", "n", "total"))
        self.keys = np.unique(key)
        self.salts = int(salt.max()) + 1
        code = np.searchsorted(self.keys, key) * self.salts + salt
        self.codes = np.unique(code)
        base = np.searchsorted(self.codes, code) * _STRIDE + _HALF
        self.lists = Lists(first + base, last + base, n, total, base)

    def results(self, rows: pa.Table) -> pa.Table | None:
        key, salt, first, last, n = (rows.column(c).to_numpy() for c in ("key", "salt", "first", "last", "n"))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        code = at * self.salts + salt
        unit = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = np.flatnonzero((self.keys[at] == key) & (salt < self.salts) & (self.codes[unit] == code))
        base = unit[known] * _STRIDE + _HALF
        found = self.lists.related(first[known] + base, last[known] + base, base)
        who, kind = np.nonzero(found[:, :, 0])
        if not len(who):
            return None
        mine = found[who, kind] * n[known[who]][:, None]
        both_open = (last[known[who]] == OPEN) & (kind % 3 == 1)
        ids = rows.column("id").combine_chunks().take(pa.array(known[who]))
        return pa.table([ids, pa.array(RELATIONS).take(pa.array(kind)), pa.array(mine[:, 0]), pa.array(mine[:, 1], mask=both_open), pa.array(mine[:, 2])], names=["id", "relation", "n_pairs", "shared", "total"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole shards, in order of (shard, query): the intervals of a shard, then its queries."""
    names = ["shard", "query", "key", "salt", "first", "last", "n", "total", "id"]
    held: list[pa.Table] = []
    now, shard = None, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if held:
            rows = pa.concat_tables(held)
            held.clear()
            if not now[1]:
                shard = Shard(rows)
            elif shard is not None and (found := shard.results(rows)) is not None:
                yield from found.combine_chunks().to_batches()

    for batch in batches:
        kinds = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            kind = divmod(int(kinds[i]), 2)
            if kind != now or (kind[1] and sum(x.num_rows for x in held) >= AT_ONCE):
                yield from flush()
                if now is None or kind[0] != now[0]:
                    shard = None
                now = kind
            held.append(pa.Table.from_batches([batch.slice(i, j - i)]).rename_columns(names))
    yield from flush()
    common.release()


def related(queries: DataFrame, intervals: DataFrame, rows: int) -> DataFrame:
    """(id, relation, n_pairs, shared, total) of queries (id, key, first, last, n) that meet intervals (key, first, last, n, total).

    ``first`` and ``last`` are inclusive longs below ``OPEN`` in size, ``last`` is ``OPEN`` for none; ``n`` is how many
    equal ones a row stands for.  ``rows`` says about how many queries there are.
    """
    shards = common.parts_for(rows, PER_SHARD)
    most = max(PER_SHARD, rows // SHARES)
    # by count at most SHARES keys, in a million bytes or so
    hot = queries.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > most).select("key", F.ceil(F.col("m") / PER_SHARD).cast("int").alias("salts"))
    hot = F.broadcast(common.stored(hot))
    salts = F.coalesce("salts", F.lit(1))
    shard = F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).alias("shard")
    valid = (F.col("first") <= F.col("last")) & F.col("key").isNotNull()
    asked = queries.filter(valid).join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("id", "first", "last"), salts).cast("int"))
    asked = asked.select(shard, F.lit(1).alias("query"), "key", "salt", "first", "last", "n", F.lit(0).cast("long").alias("total"), "id")
    met = intervals.filter(valid).join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    met = met.select(shard, F.lit(0).alias("query"), "key", "salt", "first", "last", "n", "total", F.lit(None).cast(queries.schema["id"].dataType).alias("id"))
    dealt = met.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    id_type = queries.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(_search, f"id {id_type}, relation string, n_pairs long, shared long, total long")
    return found.groupBy("id", "relation").agg(*(F.sum(c).alias(c) for c in ("n_pairs", "shared", "total")))


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970 that the clock shows, or those of an instant."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"CAST(1000000 * CAST({name} - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS DECIMAL(20, 6)) AS BIGINT)")
    return F.unix_micros(name)


def slot(at: Column) -> Column:
    """Whole slots since 1970, downwards."""
    return ((at - F.pmod(at, F.lit(SLOT))) / SLOT).cast("long")


def sessions(clicks: DataFrame) -> DataFrame:
    """(client_id, began, ended, open) of the click sessions of each client, in microseconds.

    Clicks of a client in one cell of 15 minutes are in one session, so cells are summed up first, and
    the cells of a client are put in order by day.
    """
    us = clicks.filter("client_id is not null and ts is not null").select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("long").alias("err"))
    cell = ((F.col("us") - F.pmod("us", F.lit(GAP))) / GAP).cast("long").alias("cell")
    # the last time and, in its lowest bit, whether an error has it
    cells = us.groupBy("client_id", cell).agg(F.min("us").alias("lo"), F.max(F.col("us") * 2 + F.col("err")).alias("hi"))
    cells = cells.withColumn("day", F.floor(F.col("cell") / PER_DAY))
    # parts of sessions within a day, numbered from 0: at most 96 cells of a client are together
    order = Window.partitionBy("client_id", "day").orderBy("cell")
    apart = F.col("lo") - F.shiftright(F.lag("hi").over(order), 1) > GAP
    numbered = cells.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("nth", F.sum("new").over(order))
    parts = numbered.groupBy("client_id", "day", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a row a day says whether its first part goes on with the last one of the day before, and which session that is
    days = parts.groupBy("client_id", "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("nth").alias("last"))
    along = Window.partitionBy("client_id").orderBy("day")
    joined = F.coalesce(F.col("lo") - F.shiftright(F.lag("hi").over(along), 1) <= GAP, F.lit(False))
    named = days.withColumn("joined", joined).withColumn("anchor", F.when((F.col("last") > 0) | ~F.col("joined"), F.col("day") * PER_DAY + F.col("last")))
    before = F.last("anchor", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    named = named.select("client_id", "day", F.when(F.col("joined"), before).alias("goes_on"))
    whole = parts.join(named, ["client_id", "day"]).withColumn("session", F.coalesce(F.when(F.col("nth") == 0, F.col("goes_on")), F.col("day") * PER_DAY + F.col("nth")))
    found = whole.groupBy("client_id", "session").agg(F.min("lo").alias("began"), F.max("hi").alias("hi"))
    return found.select("client_id", "began", F.shiftright("hi", 1).alias("ended"), (F.col("hi") % 2 != 0).alias("open"))


def session_slots(clicks: DataFrame) -> DataFrame:
    """(key, first, last, n, total): the slots that sessions take, how many take the same, and the sum of their digests."""
    last = F.when(F.col("open"), F.lit(OPEN)).otherwise(slot(F.col("ended")))
    each = sessions(clicks).select(F.col("client_id").cast("long").alias("key"), slot(F.col("began")).alias("first"), last.alias("last"), F.crc32(F.col("began").cast("string").cast("binary")).alias("crc"))
    return each.groupBy("key", "first", "last").agg(F.count("*").alias("n"), F.sum("crc").alias("total"))


def sale_slots(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, key, first, last, n): the slots from a sale to its last shipment; rows that are alike are one."""
    known = sales.filter("client_id is not null and sold_at is not null")
    sold = known.select(F.col("sale_id").alias("id"), F.col("client_id").cast("long").alias("key"), slot(micros(sales, "sold_at")).alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    sold = sold.groupBy("id", "key", "first", "open").agg(F.count("*").alias("n"))
    shipped = lines.filter("sale_id is not null and shipped_at is not null").groupBy(F.col("sale_id").alias("id")).agg(F.max(slot(micros(lines, "shipped_at"))).alias("shipped"))
    last = F.when(F.col("open"), F.lit(OPEN)).otherwise(F.greatest("first", "shipped"))
    return sold.join(shipped, "id", "left").select("id", "key", "first", last.alias("last"), "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (common.table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines"))
    asked = common.stored(sale_slots(sales, lines))
    found = related(asked, session_slots(clicks), asked.count())
    return found.select(F.col("id").alias("sale_id"), "relation", "n_pairs", F.col("shared").alias("overlap_slots"), F.col("total").alias("sessions_crc"))


SQL = """
WITH bits AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))
), stepped AS (
  SELECT client_id, ts, kind, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM stepped
), ranked AS (
  SELECT *, max(ts) OVER (PARTITION BY client_id, nth) AS top FROM numbered
), sessions AS (
  SELECT client_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, coalesce(bool_or(kind = 'error' AND ts = top), false) AS is_open FROM ranked GROUP BY client_id, nth
), met AS (
  SELECT client_id, floor(began / 21600000000.0)::BIGINT AS t0, CASE WHEN is_open THEN 1099511627776 ELSE floor(ended / 21600000000.0)::BIGINT END AS t1,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(began::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a // 256, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM sessions, bits
), shipped AS (
  SELECT sale_id, max(shipped_at) AS latest FROM sale_lines GROUP BY sale_id
), asked AS (
  SELECT s.sale_id, s.client_id, floor(epoch_us(sold_at) / 21600000000.0)::BIGINT AS a,
    CASE WHEN coalesce(status = 'open', false) THEN 1099511627776 ELSE floor(epoch_us(greatest(sold_at, latest)) / 21600000000.0)::BIGINT END AS b
  FROM sales s LEFT JOIN shipped p ON p.sale_id = s.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), pairs AS (
  SELECT sale_id, crc, CASE WHEN t1 = 1099511627776 AND b = t1 THEN NULL ELSE least(b, t1) - greatest(a, t0) + 1 END AS shared,
    CASE WHEN a < t0 THEN CASE WHEN b < t1 THEN 'overlaps' WHEN b = t1 THEN 'finished_by' ELSE 'contains' END
      WHEN a = t0 THEN CASE WHEN b < t1 THEN 'starts' WHEN b = t1 THEN 'equals' ELSE 'started_by' END
      ELSE CASE WHEN b < t1 THEN 'during' WHEN b = t1 THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM asked JOIN met ON asked.client_id = met.client_id AND a <= t1 AND t0 <= b
)
SELECT sale_id, relation, count(*) AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM pairs GROUP BY sale_id, relation
"""

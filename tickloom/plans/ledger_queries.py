"""Accounts, journals, files and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import documents as D
from tickloom.operators import ledger as L
from tickloom.sources import files
from tickloom.streaming import bars as S

from .analytics_queries import _HYBRID, _POST, hybrid, postings, trades
from .bar_queries import R4, rounded, rounding
from .oracle import TICKS, TRADES, bars_cte
from .research_queries import _shared

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def by_part(s, d):
    """The trades with a part as their account."""
    x = s.read.parquet(f"{d}/lineitem.parquet")
    side = F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side")
    price, fee = (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * F.col("l_extendedprice")).alias("commission")
    return x.select(F.col("l_partkey").alias("account"), side, F.col("l_quantity").alias("shares"), price, fee, F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))


#: One row a trade, numbered within its account.
_ACC = f"{TRADES}, t AS (SELECT l_partkey AS account, CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS shares, l_extendedprice / l_quantity AS price, l_tax * l_extendedprice AS commission, l_shipdate AS ts, l_orderkey AS ok, l_linenumber AS ln FROM lineitem), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, ok, ln, side, shares, price, commission) AS i FROM t)"
_ENTRY = "CASE WHEN abs(p + q) < 1e-12 THEN 0 WHEN p * q >= 0 THEN (e * abs(p) + x * abs(q)) / abs(p + q) WHEN (p + q) * p < 0 THEN x ELSE e END"
_LAST = "SELECT {} FROM r JOIN (SELECT account, max(i) AS i FROM k GROUP BY 1) m ON m.account = r.account AND m.i = r.i"
query("account_entries", f"""WITH RECURSIVE {_ACC}, r AS (SELECT DISTINCT account, 0::BIGINT AS i, 0e0 AS c, 0e0 AS p, 0e0 AS e FROM k
  UNION ALL SELECT account, i, c - q * x - f, CASE WHEN abs(p + q) < 1e-12 THEN 0 ELSE p + q END, {_ENTRY} FROM (SELECT k.account, k.i, r.c, r.p, r.e, CASE k.side WHEN 'buy' THEN k.shares ELSE -k.shares END AS q, k.price AS x, k.commission AS f FROM r JOIN k ON k.account = r.account AND k.i = r.i + 1))
  {_LAST.format("r.account, round(c, 6) AS cash, round(p, 6) AS position, round(e, 6) AS entry, r.i AS n")}""")(
    lambda s, d: L.replayed(by_part(s, d), "account").select("account", F.round("cash", 6).alias("cash"), F.round("position", 6).alias("position"), F.round("entry", 6).alias("entry"), "n"))
query("paper_broker", f"""WITH RECURSIVE {_ACC}, r AS (SELECT DISTINCT account, 0::BIGINT AS i, 500000e0 AS c, 0e0 AS p, 0e0 AS e, 0::BIGINT AS filled, 0::BIGINT AS rejected FROM k
  UNION ALL SELECT account, i, CASE WHEN good THEN c - CASE WHEN buy THEN v / 2 + v * 0.001e0 ELSE -(v - v * 0.001e0) END ELSE c END, CASE WHEN NOT good THEN p WHEN abs(p + q) < 1e-12 THEN 0 ELSE p + q END, CASE WHEN good THEN {_ENTRY} ELSE e END, filled + good::INT, rejected + (NOT good)::INT
  FROM (SELECT *, n > 0 AND v >= 10000 AND (NOT buy OR c >= v / 2 + v * 0.001e0) AS good, CASE WHEN buy THEN n ELSE -n END AS q FROM (SELECT *, x * n AS v FROM (SELECT k.account, k.i, r.c, r.p, r.e, r.filled, r.rejected, k.side = 'buy' AS buy, k.price * CASE k.side WHEN 'buy' THEN 1.0005e0 ELSE 0.9995e0 END AS x, CASE k.side WHEN 'buy' THEN k.shares ELSE least(k.shares, r.p) END AS n FROM r JOIN k ON k.account = r.account AND k.i = r.i + 1))))
  {_LAST.format("r.account, round(c, 6) AS cash, round(p, 6) AS position, round(e, 6) AS entry, filled, rejected")}""")(
    lambda s, d: L.paper(by_part(s, d), "account", 500_000.0).select("account", F.round("cash", 6).alias("cash"), F.round("position", 6).alias("position"), F.round("entry", 6).alias("entry"), "filled", "rejected"))
_PNL = "CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares - commission"
query("circuit_breaker", f"WITH {_ACC}, y AS (SELECT account, ts, ok, ln, shares, price, round(sum({_PNL}) OVER (PARTITION BY account, ts::DATE ORDER BY ts, ok, ln, shares, price ROWS UNBOUNDED PRECEDING), 6) < -20000 AS lost FROM t) SELECT account, ok, ln, coalesce(max(lost) OVER (PARTITION BY account ORDER BY ts, ok, ln, shares, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tripped FROM y")(
    lambda s, d: L.broken(by_part(s, d).withColumn("pnl", F.expr(_PNL)), "account", 20_000.0))
query("liquidity_cap", f"WITH {TRADES}, x AS (SELECT *, sum(shares) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, ok, ln, shares, price ROWS UNBOUNDED PRECEDING) AS u FROM trades) SELECT ok, ln, round(least(u, 100) - least(u - shares, 100), 6) AS filled FROM x")(
    lambda s, d: L.capped(trades(s, d), F.to_date("ts"), F.lit(100.0)).select("ok", "ln", F.round("filled", 6).alias("filled")))
query("iceberg", "WITH o AS (SELECT o_orderkey AS id, o_totalprice AS qty, greatest(round(o_totalprice * 0.1e0, 8), o_totalprice / 100) AS shown FROM orders), x AS (SELECT *, unnest(range(CAST(ceil(round(qty / shown, 9)) AS BIGINT))) AS slice FROM o) SELECT id, slice::INT AS slice, round(least(shown, qty - shown * slice), 4) AS shares FROM x")(
    lambda s, d: rounded(L.iceberg(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("qty"))), 4))
query("limit_chase", "SELECT o_orderkey AS id, i::INT AS attempt, round(o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * i * 0.01e0, 6) AS price FROM orders, (SELECT unnest(range(5)) AS i)")(
    lambda s, d: rounded(L.chased(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side"), F.col("o_totalprice").alias("price")), 0.01, 5)))
query("equity_tail", f"WITH {TRADES}, y AS (SELECT ts::DATE AS day, sum({_PNL}) AS pnl FROM trades GROUP BY 1), x AS (SELECT day, sum(pnl) OVER (ORDER BY day) AS equity FROM y ORDER BY day DESC LIMIT 60) SELECT day, round(equity, 2) AS equity FROM x ORDER BY day")(
    lambda s, d: trades(s, d).withColumn("pnl", F.expr(_PNL)).groupBy(F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl")).select("day", F.round(F.sum("pnl").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("equity")).orderBy(F.desc("day")).limit(60).orderBy("day"))
query("audit_range", "SELECT event_id, event_type, ts FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").filter("ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-13'").select("event_id", "event_type", "ts"))
query("daily_audit", "SELECT 'orders' AS kind, o_orderstatus AS what, count(*) AS n FROM orders WHERE o_orderdate::DATE = DATE '1998-03-02' GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events WHERE ts::DATE = DATE '2024-01-15' GROUP BY 2")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").filter("to_date(o_orderdate) = DATE '1998-03-02'").groupBy(F.lit("orders").alias("kind"), F.col("o_orderstatus").alias("what")).agg(F.count("*").alias("n")).unionByName(s.read.parquet(f"{d}/events.parquet").filter("to_date(ts) = DATE '2024-01-15'").groupBy(F.lit("events").alias("kind"), F.col("event_type").alias("what")).agg(F.count("*").alias("n"))))
query("hydration", f"WITH {TRADES}, x AS (SELECT * FROM trades ORDER BY ts DESC, ok DESC, ln DESC LIMIT 2000) SELECT ts::DATE AS day, round(sum({_PNL}), 2) AS pnl, count(*) AS n FROM x GROUP BY 1")(
    lambda s, d: trades(s, d).orderBy(F.desc("ts"), F.desc("ok"), F.desc("ln")).limit(2000).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(F.expr(_PNL)), 2).alias("pnl"), F.count("*").alias("n")))
query("run_manifest", f"WITH {bars_cte()} SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, sha256(string_agg(printf('%.6f', close), ',' ORDER BY ts)) AS digest FROM bars GROUP BY 1")(
    lambda s, d: B.bars_of(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda x: F.format_string("%.6f", x["close"])), ","), 256).alias("digest")))
query("timestamp_extraction", "WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts::VARCHAR WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT)::VARCHAR ELSE 'n/a' END AS t, ts, user_id FROM events) SELECT event_id, coalesce(CAST(floor(epoch(TRY_CAST(t AS TIMESTAMP))) AS BIGINT), TRY_CAST(t AS BIGINT), row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS at FROM x")(
    lambda s, d: _epochs(s, d))


def _epochs(s, d):
    """Seconds of a column of mixed kinds: a time, a number, or else the place of the row."""
    t = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(ts AS STRING) WHEN 1 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING) ELSE 'n/a' END")
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", t.alias("t"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return x.select("event_id", F.coalesce(F.expr("CASE WHEN t LIKE '%-%' THEN unix_seconds(try_cast(t AS TIMESTAMP)) END"), F.expr("try_cast(t AS BIGINT)"), place.cast("long")).alias("at"))


query("refresh", "WITH o AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, o_totalprice AS price, o_orderkey AS seq FROM orders), old AS (SELECT * FROM o WHERE seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY seq DESC) = 1), new AS (SELECT * FROM o WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY seq DESC) = 1) SELECT coalesce(new.symbol, old.symbol) AS symbol, count(*) AS n, count(*) FILTER (old.day IS NULL) AS added FROM old FULL JOIN new ON old.symbol = new.symbol AND old.day = new.day GROUP BY 1")(
    lambda s, d: _refreshed(s, d))


def _refreshed(s, d):
    """A fetch merged into what is there, the newer row of a day kept, and how many days are new."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("seq"))
    both = o.filter("seq % 3 <> 0").withColumn("batch", F.lit(1)).unionByName(o.filter("seq % 2 = 0").withColumn("batch", F.lit(2)))
    days = both.groupBy("symbol", "day").agg(F.min("batch").alias("first"))
    return days.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("first") == 2).alias("added"))


# files that are written and opened again
_F4 = ", ".join(f"round({c}::FLOAT::DOUBLE, 4) AS {c}" for c in files.PRICES)


def _binary(s, d):
    at = _shared(s)
    files.write_files(files.to_binary(B.bars_of(s, d)), f"{at}/bars", ".bin")
    return rounded(files.read_binary(s, f"{at}/bars", "2024-01-10"), 4)


def _arrow(s, d):
    at = _shared(s)
    files.write_files(files.to_arrow(B.bars_of(s, d)), f"{at}/bars", ".arrow")
    return rounded(files.read_arrow(s, f"{at}/bars", end="2024-01-20"))


def _csv(s, d):
    at = _shared(s)
    files.write_csv(B.bars_of(s, d), f"{at}/bars")
    return rounded(files.read_csv(s, f"{at}/bars", "2024-01-05", "2024-01-25"))


def _parquet(s, d):
    at = _shared(s)
    files.write_parquet(B.bars_of(s, d), f"{at}/bars")
    return rounded(files.read_parquet(s, f"{at}/bars", ["symbol", "ts", "close", "missing"], "2024-01-05", "2024-01-25"))


def _replaced(s, d):
    """A second save replaces the symbols that it has and leaves the others."""
    at, b = _shared(s), B.bars_of(s, d)
    files.write_parquet(b, f"{at}/bars")
    files.write_parquet(b.filter("symbol IN ('view', 'click')").withColumn("close", F.col("close") + 1), f"{at}/bars")
    return rounded(files.read_parquet(s, f"{at}/bars", ["symbol", "ts", "close"]))


def _preload(s, d):
    """A CSV file with headers of any case and values that are no numbers."""
    at = _shared(s)
    odd = B.bars_of(s, d).selectExpr("symbol AS Symbol", "ts AS DATE", "open AS Open", "CAST(close AS STRING) AS Close").withColumn("Close", F.when(F.hour("DATE") == 8, "n/a").otherwise(F.col("Close")))
    odd.write.csv(f"{at}/odd", header=True)
    return rounded(files.preload(s, f"{at}/odd"))


query("file_binary", f"WITH {bars_cte()} SELECT symbol, ts, {_F4} FROM bars WHERE ts >= TIMESTAMP '2024-01-10'")(_binary)
query("file_arrow", f"WITH {bars_cte()} SELECT symbol, ts, {R4} FROM bars WHERE ts <= TIMESTAMP '2024-01-20'")(_arrow)
query("file_csv", f"WITH {bars_cte()} SELECT symbol, ts, {R4} FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")(_csv)
query("file_parquet", f"WITH {bars_cte()} SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")(_parquet)
query("save_replace", f"WITH {bars_cte()} SELECT symbol, ts, round(close + CASE WHEN symbol IN ('view', 'click') THEN 1 ELSE 0 END, 6) AS close FROM bars")(_replaced)
query("preload_csv", f"WITH {bars_cte()} SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close FROM bars WHERE hour(ts) <> 8")(_preload)
query("parquet_metadata", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem")(lambda s, d: files.footers(s, f"{d}/lineitem.parquet").select(F.lit("lineitem").alias("name"), "n"))

# streams, run to their end
_STREAM = "SELECT event_type AS symbol, ts, value AS price, event_id AS seq FROM events"


def _ticks(s, d):
    e = S.read(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def _run(s, out, mode="append"):
    at = _shared(s)
    S.run_to(out, f"{at}/out", f"{at}/state", mode)
    return S.result(s, f"{at}/out", out.schema)


query("stream_intervals", " UNION ALL ".join(f"SELECT '{n}' AS interval, * FROM (WITH {bars_cte(e)} SELECT symbol, ts::TIMESTAMP AS ts, {R4} FROM bars)" for n, e in (("1h", "1 hour"), ("4h", "4 hours"), ("1d", "1 day"))))(
    lambda s, d: rounded(_run(s, S.intervals(_ticks(s, d), {"1h": "1 hour", "4h": "4 hours", "1d": "1 day"}), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
query("stream_journal", f"WITH t AS ({_STREAM}) SELECT symbol, ts, round(price, 6) AS price, seq FROM t")(lambda s, d: rounded(_run(s, _ticks(s, d).select("symbol", "ts", "price", "seq"))))
query("stream_online_mean", f"WITH t AS ({TICKS}), x AS (SELECT symbol, ts, price AS close, avg(price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING) AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM t) SELECT symbol, ts, round(close, 6) AS close, round(CASE WHEN rn >= 10 THEN m END, 6) AS mean FROM x")(
    lambda s, d: rounded(_run(s, S.online_mean(_ticks(s, d).withColumn("close", F.col("price")), 10))))
query("stream_online_features", f"""WITH RECURSIVE t AS ({TICKS}), n AS MATERIALIZED (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS step FROM t),
  r AS (SELECT symbol, 15::BIGINT AS rn, avg(greatest(step, 0)) AS g, avg(greatest(-step, 0)) AS l FROM n WHERE rn BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT n.symbol, n.rn, (r.g * 13 + greatest(n.step, 0)) / 14, (r.l * 13 + greatest(-n.step, 0)) / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1)
  SELECT n.symbol, n.ts, round(n.price, 6) AS close, round(n.price / (n.price - n.step) - 1, 6) AS ret, round(CASE WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 4) AS rsi FROM n LEFT JOIN r USING (symbol, rn)""")(
    lambda s, d: _run(s, S.online_features(_ticks(s, d).withColumn("close", F.col("price")), 14)).select("symbol", "ts", rounding(F.col("close"), 6).alias("close"), rounding(F.col("ret"), 6).alias("ret"), rounding(F.when(F.col("symbol").isNotNull(), F.col("rsi")), 4).alias("rsi")))
query("stream_positions", f"WITH t AS ({TICKS}), p AS (SELECT symbol, ts, CAST(sign(price - 50) AS INT) AS pos, seq FROM t), c AS (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY ts, seq) AS was FROM p) SELECT symbol, ts, CASE WHEN pos > was THEN 'buy' ELSE 'sell' END AS action, CASE WHEN pos = 0 THEN 'close' WHEN was = 0 THEN 'open' ELSE 'reverse' END AS intent FROM c WHERE pos <> was")(
    lambda s, d: _run(s, S.position_changes(_ticks(s, d).withColumn("pos", F.signum(F.col("price") - 50).cast("int")))))
query("stream_health", f"WITH t AS ({_STREAM}), k AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t) SELECT symbol, count(*) AS n, count(*) FILTER (ts <= last) AS out_of_order, max(ts)::TIMESTAMP AS last_ts, count(*) FILTER (ts <= last) = 0 AND date_diff('second', max(ts)::TIMESTAMP, TIMESTAMP '2024-01-31') < 86400 AS healthy FROM k GROUP BY 1")(
    lambda s, d: _run(s, S.ordering(_ticks(s, d))).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(~F.col("in_order")).alias("out_of_order"), F.max("ts").alias("last_ts")).withColumn("healthy", (F.col("out_of_order") == 0) & F.expr("timestampdiff(SECOND, last_ts, timestamp_ntz'2024-01-31') < 86400")))

# retrieval
query("index_removed", f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p WHERE doc_id % 10 <> 3 GROUP BY 1")(
    lambda s, d: postings(s, d).join(s.read.parquet(f"{d}/documents.parquet").filter("doc_id % 10 = 3").select("doc_id"), "doc_id", "left_anti").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
query("retrieve_filtered", f"WITH {_HYBRID}, j AS (SELECT h.query_id, h.doc_id, round(h.score, 9) AS score FROM h JOIN documents x ON x.doc_id = h.doc_id WHERE x.lang = 'en') SELECT query_id, doc_id, score FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5")(
    lambda s, d: D.reranked(hybrid(s, d).withColumn("score", F.round("score", 9)).join(s.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select("doc_id"), "doc_id"), 5).select("query_id", "doc_id", "score"))
query("vector_retention", "SELECT vec_id FROM embeddings WHERE vec_id >= 100 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 20")(
    lambda s, d: B.keep_n(s.read.parquet(f"{d}/embeddings.parquet").filter("vec_id >= 100").select("vec_id", "label"), ["label"], [F.desc("vec_id")], 20).select("vec_id"))
_PROMPT = {k: (a or "", b) for k, (a, b) in D.TEMPLATES.items()}


def _prompt_sql(name: str) -> str:
    system, user = _PROMPT[name]
    quoted = "'" + ((system.strip() + "\n\n" if system else "") + user.strip()).replace("'", "''") + "'"
    return f"SELECT doc_id, '{name}' AS template, md5(replace(replace({quoted}, '{{query}}', 'what is ' || doc_id), '{{context}}', CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END)) AS digest FROM documents WHERE length(text) > 20 AND NOT contains(text, '{{')"


query("prompts", " UNION ALL ".join(_prompt_sql(k) for k in _PROMPT))(
    lambda s, d: D.prompts(s.read.parquet(f"{d}/documents.parquet").filter("length(text) > 20 AND NOT contains(text, '{')").select("doc_id", F.concat(F.lit("what is "), F.col("doc_id")).alias("query"), F.col("text").alias("context")), 300).select("doc_id", "template", F.md5("prompt").alias("digest")))
query("knn_vote", "WITH q AS (SELECT a.vec_id AS query_id, b.vec_id, CASE WHEN b.label < 5 THEN 1 ELSE -1 END AS vote, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: ln(1 + abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) <= 8) SELECT query_id, CAST(sign(sum(vote)) AS INT) AS vote FROM n GROUP BY 1")(
    lambda s, d: D.voted(D.nearest(s.read.parquet(f"{d}/embeddings.parquet"), k=9, metric="log"), s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.expr("CASE WHEN label < 5 THEN 1 ELSE -1 END AS vote")), 8))

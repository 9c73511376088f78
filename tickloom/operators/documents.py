"""Documents for retrieval: normalising, sentence chunks, hash embeddings, contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that are split at once.
PER_SLICE = 100
#: Fixed value: where sentences end.
_ENDS = re.compile(r"(?<=[。！？.!?\n])\s*")


def normalised(text: Column) -> Column:
    """Runs of newlines and of blanks as one, ends trimmed; null stays null."""
    s = F.regexp_replace(F.regexp_replace(text, "\n+", "\n"), "[ \t]+", " ")
    return F.regexp_replace(s, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def packed(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Sentences packed greedily into chunks; each next chunk begins with the last whole ones within ``overlap``."""
    chunks: list[str] = []
    held: list[str] = []
    room = size
    for s in sentences:
        cost = len(s) + 1
        if held and cost > room:
            chunks.append(" ".join(held))
            costs = np.cumsum([len(x) + 1 for x in reversed(held)])
            kept = int(np.searchsorted(costs, overlap, side="right"))
            held = held[len(held) - kept :]
            room = size - (int(costs[kept - 1]) if kept else 0)
        held.append(s)
        room -= cost
    return [*chunks, " ".join(held)] if held else chunks


def sentence_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, least: int = 20) -> DataFrame:
    """(doc_id, idx, chunk) of the texts; chunks shorter than ``least`` are left out, null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a batch only some texts are Python's at a time
        for batch in batches:
            for start in range(0, batch.num_rows, PER_SLICE):
                part = batch.slice(start, PER_SLICE)
                rows: tuple[list, list, list] = ([], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    parts = [p.strip() for p in _ENDS.split((text or "").strip())]
                    kept = [c for c in packed([p for p in parts if p], size, overlap) if len(c) >= least]
                    rows[0].extend([doc_id] * len(kept))
                    rows[1].extend(range(len(kept)))
                    rows[2].extend(kept)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "idx", "chunk"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, idx long, chunk string")


def hash_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector that depends on the text alone: normal draws seeded, by a fixed rule, by the first 8 hex digits of its SHA-256."""
    v = np.random.default_rng(int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)).standard_normal(dim).astype(np.float32)
    return v / (np.linalg.norm(v) or 1e-10)


def hash_embeddings(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """``df`` with ``embedding``; each distinct text of a batch is embedded once, null as empty."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        vectors = {t: hash_vector(t, dim) for t in texts.unique()}
        return texts.map(vectors)

    return df.withColumn("embedding", embed(F.col(text)))


def contexts(ranked: DataFrame, key: str, most: int) -> DataFrame:
    """(key, blocks, context): texts of (key, rank, text) in order of rank while they fit into ``most`` characters."""
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"), F.lit("\n"))
    fits = ranked.withColumn("block", block).withColumn("end", F.sum(F.length("block")).over(w)).filter(F.col("end") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))  # ``most`` characters at most
    return fits.groupBy(key).agg(F.count("*").alias("blocks"), F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"))


def runs(chunks: DataFrame) -> DataFrame:
    """(doc_id, first, last, n) of chunks that follow one another in a document."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return chunks.withColumn("g", F.col("idx") - F.row_number().over(w)).groupBy("doc_id", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("g")


def nearest(vectors: DataFrame, every: int = 50, k: int = 10, per_block: int = 8192, per_queries: int = 4096, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, sim): the k vectors of highest cosine to each one whose id is divisible by ``every``, itself included.

    With ``metric`` "log" likeness is minus the sum of ln(1 + distance) over the dimensions.

    Queries meet vectors block by block, so a task holds one block of either and nothing is broadcast.  Cosines
    equal to nine places are ranked by id.  Rows without an id or with a null or zero vector have no cosine.
    """
    x = vectors.filter("vec_id IS NOT NULL AND exists(embedding, v -> v <> 0)").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    count = x.count()
    v_blocks, q_blocks = (max(1, -(-n // size)) for n, size in ((count, per_block), (count // every, per_queries)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = x.filter(F.col("vec_id") % every == 0).withColumn("qb", block(q_blocks)).withColumn("vb", numbers(v_blocks))
    right = x.withColumn("vb", block(v_blocks)).withColumn("qb", numbers(q_blocks))

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(v):
            v = v.sort_values("vec_id")
            ids, a, b = v["vec_id"].to_numpy(), np.stack(v["embedding"].to_list()), np.stack(q["embedding"].to_list())
            if metric == "cosine":
                a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
            for start in range(0, len(b), 256):
                some = b[start : start + 256]
                sims = np.round(some @ a.T if metric == "cosine" else np.stack([-np.log1p(np.abs(a - q)).sum(1) for q in some]), 9)
                least = np.partition(sims, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                for query, row, at_least in zip(q["vec_id"].iloc[start : start + 256], sims, least, strict=True):
                    at = np.flatnonzero(row >= at_least)
                    found += [(query, ids[i], row[i]) for i in at[np.argsort(-row[at], kind="stable")[:k]]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "sim"]).astype({"query_id": "int64", "vec_id": "int64", "sim": "float64"})

    near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(score, "query_id long, vec_id long, sim double")
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def voted(near: DataFrame, votes: DataFrame, k: int) -> DataFrame:
    """(query_id, vote): the sign of the votes, (vec_id, vote), of the k nearest to each query but itself."""
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    others = near.filter("query_id <> vec_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return others.join(votes, "vec_id").groupBy("query_id").agg(F.signum(F.sum("vote")).cast("int").alias("vote"))


def reranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by score, the lesser id of equals: what stands for a model that ranks anew."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


#: A system part or none, and the user part, of each prompt template.
TEMPLATES = {
    "plain": (None, "基于以下参考内容回答问题。\n\n参考：\n{context}\n\n问题：{query}"),
    "alpaca": (
        "Below is an instruction that describes a task. Write a response that appropriately completes the request.",
        "### Instruction:\nBased on the context below, answer the question.\n\n### Context:\n{context}\n\n### Question:\n{query}\n\n### Response:\n",
    ),
    "chatml": (
        "You are a helpful assistant. Answer the question using only the provided context.",
        "<|im_start|>user\nContext:\n{context}\n\nQuestion: {query}<|im_end|>\n<|im_start|>assistant\n",
    ),
}


def prompts(asked: DataFrame, most: int = 0) -> DataFrame:
    """(columns, template, prompt): query and context in each template; a context longer than ``most`` is cut and marked, an empty one named as such."""
    context = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("(无)"))
    if most:
        context = F.when(F.length("context") > most, F.concat(F.substring("context", 1, most), F.lit("..."))).otherwise(context)
    whole = {k: ((system.strip() + "\n\n") if system else "") + user.strip() for k, (system, user) in TEMPLATES.items()}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.replace(F.replace(F.lit(t), F.lit("{query}"), F.col("query")), F.lit("{context}"), context).alias("prompt")) for k, t in whole.items()])).alias("x")
    return asked.select("*", rows).select(*asked.columns, "x.*")

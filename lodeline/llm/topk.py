"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt by a hash into blocks, queries too, and every block of queries meets every block of candidates. In a pair of blocks
each dimension has the candidates sorted by its component. For a query the lists are read from the end that its sign favours, a run of ranks
at a time; every candidate seen gets its full score; the query is done when the sum of what the lists can still give is below its k-th score
(a candidate not seen scores no more than that sum; equal sums go on, for a smaller id may follow). The k best of each block are merged.

Scale: blocks bound the memory of a task. Equal vectors have equal scores, so of each vector only the k + 1 smallest ids of a block can
be among the k best of any query, its own row left out: a vector that a third of all rows share costs no more than others. A stated query set
against all rows is a product of blocks by nature; queries and candidates are sent once for each block of the other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, CANDIDATES, QUERIES = 5, 4096, 4096
_FIRST_RUN = 16


def _number(a: np.ndarray, b: np.ndarray) -> type:
    """Double where inner products of rows of a and b are exact in it, else a 64-bit integer."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    return np.float64 if most < 2**52 else np.int64


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best vectors, by score and then smaller id, its own id left out.

    Queries that are not done go through a run of ranks together; runs double, so a query reads few runs more than it needs.
    """
    order = np.argsort(vectors, axis=0, kind="stable")  # ranks x dimensions, ascending
    n, width = vectors.shape
    ordered = np.take_along_axis(vectors, order, 0)
    number = _number(queries, vectors)
    asked, given = queries.astype(number), vectors.astype(number)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    seen = np.zeros((len(queries), n), bool)
    open_, at, run = np.arange(len(queries)), 0, _FIRST_RUN
    while len(open_) and at < n:
        stop = min(n, at + run)
        top, bottom = order[n - stop : n - at].T.copy(), order[at:stop].T.copy()  # a row for each dimension
        for q in open_:
            up = queries[q] >= 0
            there = np.zeros(n, bool)
            there[top[up]] = True
            there[bottom[~up]] = True
            there &= ~seen[q]
            seen[q] |= there
            new = np.flatnonzero(there)
            new = new[ids[new] != query_ids[q]]
            if len(new):
                score = np.concatenate([best[q][1], (given[new] @ asked[q]).astype(np.int64)])
                own = np.concatenate([best[q][0], ids[new]])
                if len(score) > k:
                    high = score >= np.partition(score, -k)[-k]
                    score, own = score[high], own[high]
                first = np.lexsort((own, -score))[:k]
                best[q] = own[first], score[first]
        last_up, last_down = ordered[n - stop], ordered[stop - 1]
        q = queries[open_]
        bound = np.maximum(q, 0) @ last_up + np.minimum(q, 0) @ last_down
        kth = np.array([best[i][1][k - 1] if len(best[i][1]) == k else -(2**63) for i in open_])
        open_ = open_[(bound >= kth) | (kth == -(2**63))]
        at, run = stop, run * 2
    return best


def top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row that is a query the k highest integer inner products with other rows.

    Components x count as floor(256 x). Rows with a null id, a null vector, or a null or non-finite component take no part; vectors of
    different lengths are not compared. A query's own id is left out, with all rows that repeat it. A row that repeats id and vector counts
    once. An id with several vectors asks with each: its result is the k highest products of any of them with any other row, so a vec_id
    may stand in it more than once. With fewer than k other rows all are given; an empty table gives none. Other columns are not read.
    """
    sound = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(sound)
    whole = rows.select("id", "q", F.transform("v", lambda x: F.floor(x * 256)).alias("v"), F.size("v").alias("d")).distinct()  # repeated rows meet before they are dealt
    counts = whole.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-counts[0] // candidates)), max(1, -(-counts[1] // queries))
    block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    given = whole.select("d", "id", "v", block(blocks, "c").alias("c"), every(query_blocks).alias("qb"), F.lit(False).alias("q"))
    asked = whole.where("q").select("d", "id", "v", every(blocks).alias("c"), block(query_blocks, "q").alias("qb"), F.lit(True).alias("q"))

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        width = group.column("d")[0].as_py()
        ids, asking = group.column("id").to_numpy(), group.column("q").to_numpy(zero_copy_only=False)
        v = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        from_, own = ids[~asking], v[~asking]
        order = np.lexsort((from_, *own.T)) if width else np.argsort(from_)
        from_, own = from_[order], own[order]
        new = np.ones(len(from_), bool)
        new[1:] = (own[1:] != own[:-1]).any(1)
        once = new | np.append(True, from_[1:] != from_[:-1])
        from_, own, new = from_[once], own[once], new[once]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        few = np.arange(len(new)) - start <= k
        wanted = np.unique(np.column_stack([ids[asking], v[asking]]), axis=0)
        q_ids = wanted[:, 0]
        found = threshold_search(wanted[:, 1:], q_ids, own[few], from_[few], k) if len(q_ids) and len(from_) else []
        sizes = [len(i) for i, _ in found]
        get = lambda j: np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": np.repeat(q_ids[: len(sizes)], sizes), "vec_id": get(0), "score": get(1)})

    found = given.unionByName(asked).groupBy("d", "c", "qb").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")

"""Approximate nearest neighbours by balanced posting lists.

1. Centroids are fitted on a bounded sample (``SAMPLE`` vectors, of ``SAMPLE_BYTES`` as doubles at most): repeated two-way splits of the largest
   cluster, so that clusters are balanced. There is one for about ``LIST`` vectors of the table, up to one for ``LEAST`` of the sample;
   a graph over them (nearest neighbours, kept in memory by every worker) finds a vector's closest ones. Beyond ``SAMPLE`` / ``LEAST`` lists
   their number stays and they grow, dealt in parts as in 4.
2. Each vector goes to its closest list; near a boundary also to others whose distance is within
   ``REPLICATE`` of it, ``COPIES`` at most, unless a list it is in already has a centroid much closer to theirs (``COVER`` of the vector's distance to it).
   Every vector is in one list at least.
3. A query searches the lists whose centroid distance is within a ratio of its closest one's, up to a number of lists. Ratio and number are
   measured when fitting: the smallest with which queries of the sample find ``WANTED`` of their true neighbours in it. A query that gets fewer
   than k answers that way is compared with all rows, in blocks.
4. Lists that follow each other in the order of the splits make a shard of about ``PART`` vectors. A query goes to a shard once, with the lists that it searches there, and
   is measured against the members of those lists alone; it brings its best k of a shard back. A shard with many queries or vectors is dealt in parts by hashes of
   their ids, each of about ``PART`` vectors and ``ASKED`` queries, so that a hot list is many tasks.

Equal vectors are indexed once: a group of copies gives the k + 1 smallest ids (ties go to smaller ids, so no
other id can be an answer), found by a window limited before its shuffle. Scores are Euclidean distances
in double precision on the original vectors.

Vectors that are null, zero, of another length than most, or hold null or non-finite parts
take no part; neither do rows with a null id. Repeated ids count as one candidate of each distinct
vector; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm.common import Scratch, materialize, quoted

SAMPLE, SAMPLE_BYTES, LIST, LEAST = 65_536, 128 << 20, 64, 8
COPIES, REPLICATE, COVER = 4, 1.1, 0.4
#: Share of true neighbours that the measured settings find in the sample, queries that measure it, and what their number of lists is raised by.
WANTED, MEASURED, MARGIN = 0.97, 512, 1.1
PART, ASKED, NEIGHBOURS, BEAM, OPENED = 4096, 2048, 16, 24, 4


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None, :], 0)


def _within(rough: np.ndarray, room: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of rough squared distances (infinite: not looked at), the places that can be within its (k + 1)-th smallest distance (its own vector
    may be one of them), ties included. room: what rounding may have changed; not a number: nothing is known, and the place is kept."""
    cut = np.full(len(rough), np.inf) if rough.shape[1] <= k + 1 else np.partition(np.where(np.isnan(rough), np.inf, rough), k, axis=1)[:, k]
    with np.errstate(invalid="ignore"):
        return [np.nonzero(~(r > c) & (r != np.inf))[0] for r, c in zip(rough, cut + room)]


def _rough(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, not a number beyond the range of doubles, and the room for their rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        sx, sy = (x**2).sum(axis=1), (y**2).sum(axis=1)
        d = sx[None, :] - 2 * (y @ x.T) + sy[:, None]
        room = 1e-9 * (sx.max(initial=0) + sy)
    return np.where(np.isfinite(d), d, np.nan), np.where(np.isfinite(room), room, np.inf)


def best_of_lists(y: np.ndarray, probed: list[list[int]], x: np.ndarray, within: list[list[int]], k: int):
    """For each query its places among the rows of x in the lists that it searches, and their exact distances: those up to the (k + 1)-th, ties included."""
    members, asking = {}, {}
    for held, by in ((within, members), (probed, asking)):
        for i, ls in enumerate(held):
            for l in ls:
                by.setdefault(l, []).append(i)
    rough, room = np.full((len(y), len(x)), np.inf), np.zeros(len(y))
    for l, qs in asking.items():
        if l in members:
            rows = np.array(members[l])
            d, r = _rough(y[qs], x[rows])
            rough[np.ix_(qs, rows)] = d
            room[qs] = np.maximum(room[qs], r)
    for v, near in zip(y, _within(rough, room, k)):
        d = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
        cut = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
        yield near[d <= cut], d[d <= cut]


class Centroids:
    """Balanced clusters of a sample, their graph, and the search settings measured on the sample."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, list_size: int = LIST) -> None:
        rng = np.random.default_rng(11)
        wanted = int(np.clip(rows // list_size, 1, max(1, len(sample) // LEAST)))
        parts = [(-len(sample), "1", np.arange(len(sample)))]
        for _ in range(1, wanted):
            _, path, at = heapq.heappop(parts)
            x = sample[at] - sample[at].mean(axis=0)
            axis = x[rng.integers(len(x))] - x[rng.integers(len(x))]
            for _ in range(4):  # towards the main direction, then an even cut
                axis = x.T @ (x @ axis)
                axis /= np.linalg.norm(axis) or 1.0
            order = np.argsort(x @ axis, kind="stable")
            for j, half in enumerate(np.array_split(at[order], 2)):
                heapq.heappush(parts, (-len(half), f"{path}{j}", half))
        # in the order of the splits, so that lists that follow each other lie together
        self.points = np.array([sample[p[2]].mean(axis=0) for p in sorted(parts, key=lambda p: p[1])])
        n = len(self.points)
        near = min(NEIGHBOURS, n - 1)
        graph = np.empty((n, near + 4), np.int64)
        for at in range(0, n, 1024):
            d = _squares(self.points[at : at + 1024], self.points)
            graph[at : at + 1024, :near] = np.argsort(d, axis=1, kind="stable")[:, 1 : near + 1]
        graph[:, near:] = rng.integers(n, size=(n, 4))  # long links keep distant parts reachable
        self.graph, self.entry = graph, np.unique(np.linspace(0, n - 1, 16).astype(np.int64))
        self.probes, self.prune = n, np.inf
        self._measure(sample, rng, k)

    def search(self, x: np.ndarray, most: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """About the `most` closest centroids of each vector and their distances, in order (infinite beyond those found), by a search of the graph: the closest
        of the beam whose links weren't followed yet are followed, until there are none. A centroid is measured once for a vector."""
        n, beam = len(self.points), min(max(beam, most), len(self.points))
        step = max(OPENED, beam // 8)
        seen = np.zeros((len(x), n), bool)
        last = np.empty((len(x), n), np.int32)
        seen[:, self.entry] = True
        d = _squares(x, self.points[self.entry])
        ids = np.tile(self.entry, (len(x), 1))
        if ids.shape[1] < beam:
            ids = np.pad(ids, ((0, 0), (0, beam - ids.shape[1])))
            d = np.pad(d, ((0, 0), (0, beam - d.shape[1])), constant_values=np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        fresh = np.isfinite(d)
        moving = np.nonzero(fresh.any(axis=1))[0]
        while len(moving):
            follow = fresh[moving] & (np.cumsum(fresh[moving], axis=1) <= step)  # the beam is in order
            at, place = np.nonzero(follow)
            fresh[moving[at], place] = False
            links = self.graph[ids[moving[at], place]]
            at, to = np.repeat(at, links.shape[1]), links.ravel()
            last[moving[at], to] = np.arange(len(to), dtype=np.int32)
            new = ~seen[moving[at], to] & (last[moving[at], to] == np.arange(len(to)))  # of repeats in a step the last counts
            at, to = at[new], to[new]
            seen[moving[at], to] = True
            count = np.bincount(at, minlength=len(moving))
            column = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            wide = beam + count.max(initial=0)
            all_d, all_ids, all_fresh = np.full((len(moving), wide), np.inf), np.zeros((len(moving), wide), np.int64), np.zeros((len(moving), wide), bool)
            all_d[:, :beam], all_ids[:, :beam], all_fresh[:, :beam] = d[moving], ids[moving], fresh[moving]
            apart = x[moving[at]] - self.points[to]
            all_d[at, beam + column], all_ids[at, beam + column], all_fresh[at, beam + column] = np.einsum("ij,ij->i", apart, apart), to, True
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            d[moving], ids[moving], fresh[moving] = (np.take_along_axis(a, order, 1) for a in (all_d, all_ids, all_fresh))
            moving = moving[fresh[moving].any(axis=1)]
        return ids[:, :most], np.sqrt(d[:, :most])

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists of each vector."""
        ids, d = self.search(x, min(COPIES * 2, len(self.points)), COPIES * 3)
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        close = np.isfinite(d) & (d <= REPLICATE * d[:, :1] + 1e-12)
        for j in range(1, ids.shape[1]):
            if not close[:, j].any():
                break  # they are in order
            between = np.sqrt(((self.points[ids] - self.points[ids[:, j : j + 1]]) ** 2).sum(axis=2))
            covered = (taken & (between < COVER * d[:, j : j + 1])).any(axis=1)
            taken[:, j] = close[:, j] & ~covered & (taken.sum(axis=1) < COPIES)
        rows, places = np.nonzero(taken)
        return rows, ids[rows, places]

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that each query searches."""
        ids, d = self.search(x, self.probes)
        rows, places = np.nonzero(np.isfinite(d) & (d <= self.prune * d[:, :1] + 1e-12))
        return rows, ids[rows, places]

    def _measure(self, sample: np.ndarray, rng: np.random.Generator, k: int) -> None:
        if len(self.points) < 2:
            return
        asked = rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)
        true = []
        for at in range(0, len(asked), 32):  # a few at a time: each has a distance to the whole sample
            own = asked[at : at + 32]
            d = _squares(sample[own], sample)
            d[np.arange(len(own)), own] = np.inf
            true.append(np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k])
        true = np.concatenate(true)
        away = np.sqrt(_squares(sample[asked], self.points))
        place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
        rows, lists = [], []
        flat, back = np.unique(true, return_inverse=True)
        for at in range(0, len(flat), 128):
            r, c = self.lists(sample[flat[at : at + 128]])
            rows.append(r + at)
            lists.append(c)
        rows, lists = np.concatenate(rows), np.concatenate(lists)
        first = np.searchsorted(rows, np.arange(len(flat) + 1))
        need, ratio = [], []
        for q, wanted in enumerate(back.reshape(true.shape)):
            nearest = max(away[q].min(), 1e-12)
            for t in wanted:
                own = lists[first[t] : first[t + 1]]
                need.append(place[q, own].min() + 1)
                ratio.append(away[q, own].min() / nearest)
        self.probes = int(min(len(self.points), np.ceil(np.quantile(need, WANTED) * MARGIN)))
        self.prune = float(np.quantile(ratio, WANTED + (1 - WANTED) / 2))


def usable(column):
    """Whether a vector takes part."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & whole & F.exists(column, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, list_size: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that the condition `queries` holds for."""
    with Scratch(vectors.sparkSession, "ann") as scratch:
        return materialize(_nearest(scratch, vectors, queries, k, id_col, vector_col, sample, list_size), "ann-found")


def _nearest(scratch: Scratch, vectors: DataFrame, queries, k: int, id_col: str, vector_col: str, sample: int, list_size: int) -> DataFrame:
    spark = vectors.sparkSession
    # vectors stay as narrow as they come until a task measures them
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    ok = vectors.where(F.col(quoted(id_col)).isNotNull() & usable(F.col(quoted(vector_col))))
    ok = scratch.write(ok.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).distinct(), "vectors")
    key = F.xxhash64("v")
    ranked = Window.partitionBy("key", "v").orderBy("id")
    distinct = ok.select("id", "v", key.alias("key")).distinct().withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    groups = scratch.write(distinct.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "v"), "groups")
    empty = "query_id long, rank int, vec_id long, score double"
    n, width = groups.agg(F.count("*"), F.mode(F.size("v"), True)).first()
    if not n:
        return spark.createDataFrame([], empty)
    sized = F.size("v") == width
    drawn = groups.where(sized).orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(max(1, min(sample, SAMPLE_BYTES // (8 * width)))).select("v").toArrow()

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy().reshape(-1, width).astype(np.float64)

    model = Centroids(matrix(drawn.column("v")), n, k, list_size)
    fitted = spark.sparkContext.broadcast(model)
    shards = min(len(model.points), -(-n // PART))

    def batched(choose, out_ids: str):
        """Each vector once for each shard that has lists of it, with those lists."""

        def run(batches):
            for b in batches:
                x = matrix(b.column("v"))
                for at in range(0, len(x), 128):
                    rows, lists = choose(x[at : at + 128])
                    order = np.lexsort((lists, rows))
                    rows, lists = rows[order], lists[order]
                    shard = lists * shards // len(fitted.value.points)
                    first = np.nonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (shard[1:] != shard[:-1]))))[0]
                    took = pa.array(rows[first] + at)
                    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), pa.array(lists, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column("v").take(took), held, pa.array(shard[first], pa.int32())], [out_ids, "v", "lists", "shard"])

        return run

    asked = ok.where(F.col("q") & sized).select("id", "v").mapInArrow(batched(lambda x: fitted.value.probed(x), "query_id"), f"query_id long, v {kind}, lists array<int>, shard int")
    lists = groups.where(sized).mapInArrow(batched(lambda x: fitted.value.lists(x), "ids"), f"ids array<long>, v {kind}, lists array<int>, shard int")
    asked, lists = scratch.write(asked, "asked"), scratch.write(lists, "lists")
    # how many parts of queries and of vectors each shard has; a row for each shard, of which there are no more than centroids
    heavy = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("qs"), F.lit(1).alias("vs")).unionByName(lists.groupBy("shard").agg(F.lit(1).alias("qs"), F.ceil(F.count("*") / PART).cast("int").alias("vs")))
    heavy = F.broadcast(scratch.write(heavy.groupBy("shard").agg(F.max("qs").alias("qs"), F.max("vs").alias("vs")), "heavy"))
    deal = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asked = asked.join(heavy, "shard").select("query_id", "v", "lists", "shard", deal(F.col("query_id"), "qs").alias("qp"), every("vs").alias("vp"))
    lists = lists.join(heavy, "shard").select("ids", "v", "lists", "shard", deal(F.col("ids")[0], "vs").alias("vp"), every("qs").alias("qp"))

    def search(asking: pa.Table, listed: pa.Table) -> pa.Table:
        qs, ids, scores = [], [], []
        if asking.num_rows and listed.num_rows:
            x, members, within = matrix(listed.column("v")), listed.column("ids").to_pylist(), listed.column("lists").to_pylist()
            y, names, probed = matrix(asking.column("v")), asking.column("query_id").to_pylist(), asking.column("lists").to_pylist()
            for at in range(0, len(y), 128):
                now = slice(at, at + 128)
                for q, (near, d) in zip(names[now], best_of_lists(y[now], probed[now], x, within, k)):
                    best = sorted((s, m) for i, s in zip(near.tolist(), d.tolist()) for m in members[i] if m != q)[:k]
                    qs += [q] * len(best)
                    ids += [m for _, m in best]
                    scores += [s for s, _ in best]
        return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = asked.groupBy("shard", "qp", "vp").cogroup(lists.groupBy("shard", "qp", "vp")).applyInArrow(search, "query_id long, vec_id long, score double")
    # replicas of a candidate fall together; at most k rows a query for each part of a shard that it asks
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = scratch.write(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    # queries whose lists held too little: exact search. Of repeated ids, the answers go to the id
    full = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = scratch.write(ok.where(F.col("q") & sized).select("id", "v").join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return best
    blocks = spark.sparkContext.defaultParallelism
    dealt = groups.where(sized).withColumn("lists", F.array(F.lit(0))).withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(max(blocks, n // PART))).cast("int"))
    # short queries are dealt as well, in parts of about ASKED
    rounds = -(-short.count() // ASKED)
    everywhere = short.select(F.col("id").alias("query_id"), "v", F.array(F.lit(0)).alias("lists"), F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(max(blocks, n // PART) - 1))).alias("part"))
    dealt = dealt.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    exact = everywhere.groupBy("round", "part").cogroup(dealt.groupBy("round", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    exact = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = best.join(full.withColumnRenamed("id", "query_id"), "query_id", "leftsemi")
    return kept.unionByName(exact.select("query_id", "rank", "vec_id", "score"))

"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to integers and packed into blocks of some dozen rows that
cover a range of ids. A block holds its forward index (the integer matrix) and, per
term (component), the largest and smallest value. For a query the sum over terms of
the largest possible contribution bounds every score in a block. Each query walks the
blocks in the order of that bound and scores them through their forward indexes until
the bound falls below its k-th score; equal bounds are still scored, so ties are
settled exactly.

Document blocks are shuffled once, to cells of bounded size; queries stream past the blocks
that a cell holds. First all queries meet one cell's blocks: their k-th scores there are their
seeds. Every cell has the largest and smallest value per term over its blocks, so a query's bound
for the whole cell is known before the shuffle, and it is sent only to cells whose bound reaches
its seed. These bounds go out by broadcast; where all cells' would take more than
``BOUND_BYTES``, neighbouring cells share one. A window keeps the k best.

Defined results. Vectors that are null, or hold null or non-finite components,
take no part. Only vectors of equal length meet. A candidate with the query's id
is the query's own. Rows repeated with one id are candidates each, and queries
each. Ties go to the smaller id. Null ids take no part. Components and scores are
exact; one that does not fit a long is an error. Vectors without components score 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table

K, SCALE, BLOCK_ROWS, BLOCK_BYTES, GROUP_BYTES, QUERY_ROWS = 10, 1024.0, 64, 1 << 15, 16 << 20, 2048
LEAST, BOUND_BYTES = np.iinfo(np.int64).min, 64 << 20
BLOCK = "part int, dim int, no int, n int, ids binary, marks binary, forward binary, highest binary, lowest binary"
SENT = "cell int, kind int, part int, dim int, no int, ids binary, marks binary, forward binary, highest binary, lowest binary, seeds binary"
CELL = ["cell", "kind", "part", "dim", "no", "ids", "marks", "forward", "highest", "lowest", "seeds"]


def _pack(scale: float):
    """Rows of a partition, by id, as blocks of rows of one length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, marks, dims, values = [], [], [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            marks.append(b.column(1).to_numpy())
            v = b.column(2)
            dims.append(np.diff(v.offsets.to_numpy()))
            values.append(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if not ids:
            return
        ids, marks, dims, values = (np.concatenate(x) for x in (ids, marks, dims, values))
        scaled = np.floor(scale * values)
        if len(scaled) and np.abs(scaled).max() >= 2.0**63:
            raise ValueError("a scaled component does not fit a long")
        starts, scaled = np.concatenate([[0], np.cumsum(dims)[:-1]]).astype(np.int64), scaled.astype(np.int64)
        part, out = TaskContext.get().partitionId(), []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            at = at[np.lexsort((marks[at], ids[at]))]
            rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(dim)))))
            for no, k in enumerate(range(0, len(at), rows)):
                own = at[k : k + rows]
                m = scaled[starts[own][:, None] + np.arange(dim)[None, :]].reshape(len(own), dim)
                out.append((part, int(dim), no, len(own), ids[own].tobytes(), marks[own].tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()))
        names = ["part", "dim", "no", "n", "ids", "marks", "forward", "highest", "lowest"]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 5
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), kinds)], names=names)

    return run


def exact_kind(queries: np.ndarray, blocks: list):
    """The fastest number type in which all scores and bounds are exact."""
    most = max((max(float(np.abs(b[2].astype(np.float64)).max(initial=0)), float(np.abs(b[3].astype(np.float64)).max(initial=0))) for b in blocks), default=0.0)
    size = float(np.abs(queries.astype(np.float64)).sum(1).max(initial=0)) * most
    return np.float64 if size < 2.0**52 else np.int64 if size < 2.0**62 else object


def prune_and_score(query_ids, queries, blocks, k: int = K, seeds=None):
    """Top k of each query, from its seed on: (scores, ids, found, blocks scored)."""
    n, kind = len(queries), exact_kind(queries, blocks)
    top_s, top_i = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)
    found, scored = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    seeds = np.full(n, LEAST) if seeds is None else seeds
    of = lambda m: m.astype(kind)
    own = of(queries)
    plus, minus = np.maximum(own, 0), np.minimum(own, 0)
    bounds = plus @ of(np.stack([b[2] for b in blocks]).T) + minus @ of(np.stack([b[3] for b in blocks]).T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(len(blocks)):
        best = order[active, step]
        bar = np.maximum(seeds[active], np.where(found[active] < k, LEAST, top_s[active, k - 1]))
        active = active[bounds[active, best] >= bar]
        if not len(active):
            break
        best = order[active, step]
        for b in np.unique(best):
            q = active[best == b]
            ids, forward = blocks[b][:2]
            scored[q] += 1
            exact = own[q] @ of(forward).T
            if kind is object and any(not LEAST < x <= np.iinfo(np.int64).max for x in exact.ravel()):
                raise OverflowError("a score does not fit a long")
            s = exact.astype(np.int64)
            use = (ids[None, :] != query_ids[q][:, None]) & (s >= seeds[q][:, None])
            found[q] += use.sum(1)
            s = np.concatenate([top_s[q], np.where(use, s, LEAST)], axis=1)
            i = np.concatenate([top_i[q], np.where(use, ids[None, :], np.iinfo(np.int64).max)], axis=1)
            first = np.lexsort((i, ~s), axis=1)[:, :k]
            top_s[q], top_i[q] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return top_s, top_i, np.minimum(found, k), scored


def _bounds(width: int):
    """Blocks to one row (group of ``width`` cells, dim, highest, lowest) each that the task has seen."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, list] = {}
        for b in batches:
            for part, dim, high, low in zip(*(b.column(c).to_pylist() for c in range(4))):
                high, low, key = np.frombuffer(high, np.int64), np.frombuffer(low, np.int64), (part // width, dim)
                held[key] = [np.maximum(held[key][0], high), np.minimum(held[key][1], low)] if key in held else [high, low]
        if held:
            columns = [pa.array([k[i] for k in held], pa.int32()) for i in (0, 1)] + [pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "dim", "highest", "lowest"])

    return run


def reached(queries: np.ndarray, seeds: np.ndarray, highest: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """(queries, groups of cells): whether the bound of the group reaches the query's seed."""
    kind = exact_kind(queries, [(None, None, highest, lowest)])
    own = queries.astype(kind)
    return np.maximum(own, 0) @ highest.astype(kind).T + np.minimum(own, 0) @ lowest.astype(kind).T >= seeds[:, None]


def _sent(shared, width: int, groups: int):
    """Query blocks with seeds to the part of each that a cell has to see, one row a cell."""

    def run(batches):
        import pyarrow as pa

        kinds = [("cell", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("dim", pa.int32()), ("no", pa.int32()), *[(c, pa.binary()) for c in CELL[5:]]]
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] not in shared.value:
                    continue
                names, highest, lowest = shared.value[r["dim"]]
                ids, marks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64)
                forward = np.frombuffer(r["forward"], np.int64).reshape(len(ids), r["dim"])
                seeds = np.full(len(ids), LEAST) if r["seeds"] is None else np.frombuffer(r["seeds"], np.int64)
                hit, out = reached(forward, seeds, highest, lowest), []
                for g in np.flatnonzero(hit.any(0)).tolist():
                    q = hit[:, g]
                    row = (1, r["part"], r["dim"], r["no"], ids[q].tobytes(), marks[q].tobytes(), forward[q].tobytes(), None, None, seeds[q].tobytes())
                    out += [(cell, *row) for cell in range(names[g] * width, min(groups, (names[g] + 1) * width))]
                for k in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out[k : k + 64]), kinds)], names=[n for n, _ in kinds])

    return run


def _cells(k: int, ahead: bool):
    """Rows come sorted by cell, blocks (kind 0) before queries (kind 1).

    ``ahead``: each query block's k-th scores, else the top k rows.
    """

    def run(batches):
        import pyarrow as pa

        cell, blocks, waiting = None, {}, []

        def answer():
            if not waiting:
                return
            dim = waiting[0]["dim"]
            of = lambda name: np.concatenate([np.frombuffer(w[name], np.int64) for w in waiting])
            ids, marks = of("ids"), of("marks")
            own = [w["seeds"] if w["seeds"] is not None else np.full(len(w["ids"]) // 8, LEAST).tobytes() for w in waiting]
            seeds = np.concatenate([np.frombuffer(x, np.int64) for x in own])
            found = np.zeros(len(ids), np.int64)
            s = i = np.zeros((len(ids), k), np.int64)
            if dim in blocks:
                s, i, found, _ = prune_and_score(ids, of("forward").reshape(len(ids), dim), blocks[dim], k, seeds)
            if ahead:
                kth, cut = np.where(found < k, LEAST, s[:, k - 1]), np.cumsum([len(w["ids"]) // 8 for w in waiting])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in waiting], pa.int32()) for c in ("part", "dim", "no")] + [pa.array([x.tobytes() for x in np.split(kth, cut)], pa.binary())], names=["part", "dim", "no", "seeds"])
            else:
                have = np.arange(k)[None, :] < found[:, None]
                rows = np.repeat(np.arange(len(ids)), k).reshape(-1, k)[have]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(marks[rows]), pa.array(i[have]), pa.array(s[have])], names=["query_id", "mark", "vec_id", "score"])
            waiting.clear()

        for batch in batches:
            for k0 in range(0, batch.num_rows, 64):
                for r in batch.slice(k0, 64).to_pylist():
                    if r["cell"] != cell:
                        yield from answer()
                        cell, blocks = r["cell"], {}
                    if r["kind"] == 0:
                        of = lambda name, r=r: np.frombuffer(r[name], np.int64)
                        blocks.setdefault(r["dim"], []).append((of("ids"), of("forward").reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0), np.int64), of("highest"), of("lowest")))
                        continue
                    if waiting and (waiting[0]["dim"] != r["dim"] or sum(len(w["ids"]) for w in waiting) >= 8 * QUERY_ROWS):
                        yield from answer()
                    waiting.append(r)
        yield from answer()

    return run


def topk_search(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("query"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = own.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", finite)).withColumn("mark", F.monotonically_increasing_id())
    valid = ws.write(valid, "valid")
    rows, size, asked, most = valid.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 16), F.count(F.when(F.col("query"), 1)), F.max(F.size("v"))).first()
    groups = max(1, -(-(size or 0) // GROUP_BYTES), min(spark.sparkContext.defaultParallelism, -(-rows // (16 * BLOCK_ROWS))))
    pack = lambda df, n: df.repartitionByRange(n, "id", "mark").select("id", "mark", "v").mapInArrow(_pack(scale), BLOCK)
    blocks = ws.write(pack(valid, groups).withColumn("kind", F.lit(0)).withColumn("seeds", F.lit(None).cast("binary")), "blocks")
    queries = ws.write(pack(valid.filter("query"), max(1, -(-asked // QUERY_ROWS))).withColumn("kind", F.lit(1)), "queries")
    ws.drop("valid")
    met = lambda a, b, n: a.select(*CELL).unionByName(b.select(*CELL)).repartition(n, "cell").sortWithinPartitions("cell", "kind", "dim")
    if groups > 1:  # all queries meet the first cell's blocks, in as many tasks as they fill
        spread = max(1, -(-asked // QUERY_ROWS))
        ahead = met(blocks.filter("part = 0").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), queries.withColumn("cell", F.col("part") % spread).withColumn("seeds", F.lit(None).cast("binary")), spread)
        seeds = ws.write(ahead.mapInArrow(_cells(k, True), "part int, dim int, no int, seeds binary"), "seeds")
        width = -(-groups * 16 * max(1, most) // BOUND_BYTES)
        known: dict[int, dict] = {}
        for r in blocks.select("part", "dim", "highest", "lowest").mapInArrow(_bounds(width), "part int, dim int, highest binary, lowest binary").toLocalIterator():  # at most about BOUND_BYTES
            own, high, low = known.setdefault(r["dim"], {}), np.frombuffer(r["highest"], np.int64), np.frombuffer(r["lowest"], np.int64)
            own[r["part"]] = (np.maximum(own[r["part"]][0], high), np.minimum(own[r["part"]][1], low)) if r["part"] in own else (high, low)
        bounds = {dim: (list(own), np.stack([h for h, _ in own.values()]), np.stack([low for _, low in own.values()])) for dim, own in known.items()}
        sent = queries.join(seeds, ["part", "dim", "no"], "left").select("part", "dim", "no", "ids", "marks", "forward", "seeds")
        queries = ws.write(sent.mapInArrow(_sent(spark.sparkContext.broadcast(bounds), width, groups), SENT), "sent")
    else:
        queries = queries.withColumn("seeds", F.lit(None).cast("binary")).withColumn("cell", F.lit(0))
    cells = met(blocks.withColumn("cell", F.col("part")), queries, groups)
    found = cells.mapInArrow(_cells(k, False), "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return ws.result(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

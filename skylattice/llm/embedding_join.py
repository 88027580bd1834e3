"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c).  Vectors are projected on leading
principal axes, sorted by their grid cells of edge eps in lexicographic order and packed into blocks,
intervals of that order.  Pairs of intervals are joined recursively, eight children at a time, as
DataFrames; a pair goes on only if the boxes of its projections come within eps.  The surviving pairs
of blocks are dealt out as tiles, TILE blocks by TILE: a block is sent to a tile once, whatever pairs it
has there, so vectors travel once for each TILE blocks they are held against.  A tile's pairs are multiplied
out, again by sub-intervals whose boxes are near; each returns its vectors' link counts and one star for
each connected group, never the pairs.  Equal vectors are one class, met once, and rows find their class by a
128-bit hash of the vector and a salt, so that copies don't fall to one task.  Axes come from a bounded
sample of vectors; they steer pruning alone, never the result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; neither do vectors of different length.  Repeated rows are vectors of their own.  Rows with a
null id link with nothing and have no component.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, joined_evenly, salted, session_conf, table

BLOCK, SUB, FAN, SAMPLE, TILE = 4096, 512, 8, 4096, 8
BLOCK_BYTES = 4 << 20  # of double precision vectors: wide ones make smaller blocks
GRID_AXES, BOX_AXES = 4, 16
SLACK = 1e-9


def principal_axes(sample: np.ndarray, most: int = BOX_AXES) -> np.ndarray:
    """Orthonormal rows; distances never grow by projecting on them."""
    if not len(sample):
        return np.eye(sample.shape[1])[:most]
    _, vec = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], sample.shape[1]))
    return np.ascontiguousarray(vec[:, ::-1].T[:most])


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def box_gap2(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Squared distance of boxes, at least."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(axis=-1)


def join_blocks(xa, pa_, wa, ida, xb, pb, wb, idb, cosine: float, same: bool):
    """Link counts, and the smallest id of the local group, of vectors with a link between two blocks (or within one).

    xa, xb: unit vectors in double precision; pa_, pb: projections; wa, wb: rows that each vector stands for.
    """
    eps2 = 2 - 2 * cosine + SLACK
    n, m = len(xa), len(xb)
    count_a, count_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    fa, fb = xa.astype(np.float32), xb.astype(np.float32)
    cuts_b = [(b, min(m, b + SUB)) for b in range(0, m, SUB)]
    box_b = [(pb[s:e].min(0), pb[s:e].max(0)) for s, e in cuts_b]
    label_a, label_b = ida.copy(), idb.copy()
    tiles = []
    for s in range(0, n, SUB):
        e = min(n, s + SUB)
        lo, hi = pa_[s:e].min(0), pa_[s:e].max(0)
        for (t, u), (lo_b, hi_b) in zip(cuts_b, box_b, strict=True):
            if (same and t < s) or box_gap2(lo, hi, lo_b, hi_b) > eps2:
                continue
            sim = fa[s:e] @ fb[t:u].T
            near = sim >= np.float32(cosine - 1e-4)
            if same and s == t:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            unsure = sim[i, j] < np.float32(cosine + 1e-4)
            if unsure.any():
                bad = np.flatnonzero(unsure)
                exact = np.concatenate([np.einsum("ij,ij->i", xa[s + i[k]], xb[t + j[k]]) for k in np.array_split(bad, -(-len(bad) // 65536))])
                near[i[bad[exact < cosine]], j[bad[exact < cosine]]] = False
            if near.any():
                rows, cols = near.any(1), near.any(0)
                count_a[s:e] += near @ wb[t:u]
                count_b[t:u] += wa[s:e] @ near
                tiles.append((s + np.flatnonzero(rows), t + np.flatnonzero(cols), near[np.ix_(rows, cols)]))
    if same:
        count_a += count_b
        label_b = label_a
    while True:
        before = label_a.copy(), label_b.copy()
        for r, c, near in tiles:
            far = np.iinfo(np.int64).max
            label_a[r] = np.minimum(label_a[r], np.where(near, label_b[c][None, :], far).min(1))
            label_b[c] = np.minimum(label_b[c], np.where(near, label_a[r][:, None], far).min(0))
        if np.array_equal(before[0], label_a) and np.array_equal(before[1], label_b):
            break
    on_a, on_b = np.flatnonzero(count_a), np.flatnonzero(count_b if not same else count_b * 0)
    return np.r_[ida[on_a], idb[on_b]], np.r_[count_a[on_a], count_b[on_b]], np.r_[label_a[on_a], label_b[on_b]]


def _links(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(id, n, low) rows of block pairs, for class representatives with `dim` components."""
    spark = classes.sparkSession
    most = max(16, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    own = classes.where(F.size("vector") == dim).select("rep", "vector", "copies")
    sample = own.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas().vector
    axes = principal_axes(unit(np.stack(sample.values).astype(np.float64)) if len(sample) else np.zeros((0, dim)))
    eps = math.sqrt(2 - 2 * cosine + SLACK)
    axes_held = spark.sparkContext.broadcast(axes)
    g = min(GRID_AXES, len(axes))

    def project(batches):
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = unit(flat.reshape(-1, dim)) @ axes_held.value.T
            cells = np.floor(at[:, :g] / eps).astype(np.int64)
            cols = [pa.array(cells[:, k]) for k in range(g)]
            fine = pa.array(at[:, 0]) if g else pa.array(np.zeros(len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, fine], names=["rep", "vector", "copies", *(f"c{k}" for k in range(g)), "fine"])

    kinds = "rep long, vector array<double>, copies long, " + "".join(f"c{k} long, " for k in range(g)) + "fine double"
    order = [*(f"c{k}" for k in range(g)), "fine", "rep"]
    # So few parts that blocks are full: a part is some blocks, and no part outgrows a task.
    total = own.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most)), -(-total // (64 * most)))
    dealt = own.select("rep", F.col("vector").cast("array<double>"), "copies").mapInArrow(project, kinds).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches):
        part, k, left = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table):
            x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = unit(x) @ axes_held.value.T
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "k": [k], "lo": [at.min(0).tolist()], "hi": [at.max(0).tolist()],
                "x": [x.tobytes()], "ids": [rows.column("rep").to_numpy().astype(np.int64).tobytes()], "copies": [rows.column("copies").to_numpy().astype(np.int64).tobytes()],
            })

        for batch in batches:
            left.append(batch.select(["rep", "vector", "copies"]))
            rows = pa.Table.from_batches(left)
            while len(rows) >= most:
                yield block(rows.slice(0, most))
                k, rows = k + 1, rows.slice(most)
            left = rows.to_batches()
        rows = pa.Table.from_batches(left) if left else None
        if rows is not None and len(rows):
            yield block(rows)

    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(most)):
        packed = checkpointed(dealt.mapInArrow(pack, "part int, k long, lo array<double>, hi array<double>, x binary, ids binary, copies binary"))
    # Blocks are numbered through by how many the parts before have: a row a part.
    first, n = [], 0
    for r in sorted(packed.groupBy("part").count().collect()):
        first.append((r.part, n))
        n += r["count"]
    places = spark.createDataFrame(first, "part int, first long")
    blocks = packed.join(F.broadcast(places), "part").select((F.col("k") + F.col("first")).alias("k"), "lo", "hi", "x", "ids", "copies")
    # Intervals of blocks, FAN of a level to one of the next; then pairs of them from the top down.
    levels = [blocks.select("k", "lo", "hi")]
    while n > 1:
        last = levels[-1]
        lows = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(len(axes))]
        highs = [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(len(axes))]
        up = last.groupBy(F.floor(F.col("k") / FAN).cast("long").alias("k")).agg(*lows, *highs)
        levels.append(up.select("k", F.array(*(f"l{i}" for i in range(len(axes)))).alias("lo"), F.array(*(f"h{i}" for i in range(len(axes)))).alias("hi")))
        n = -(-n // FAN)
    gap2 = "aggregate(zip_with(zip_with(a.lo, b.hi, (x, y) -> x - y), zip_with(b.lo, a.hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)"
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    for down in range(len(levels) - 1, -1, -1):
        boxes = levels[down]
        if down < len(levels) - 1:
            child = F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))
            pairs = pairs.withColumn("p", F.explode(child)).withColumn("q", F.explode(child)).select((F.col("i") * FAN + F.col("p")).alias("i"), (F.col("j") * FAN + F.col("q")).alias("j")).where("i <= j")
        a, b = boxes.alias("a"), boxes.alias("b")
        pairs = pairs.join(a, F.col("i") == F.col("a.k")).join(b, F.col("j") == F.col("b.k")).where(F.expr(gap2) <= eps * eps).select("i", "j")
    pairs = checkpointed(pairs)
    # A tile is TILE blocks by TILE; a block goes there once, with the numbers of those it meets.
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"t{c}") for c in "ij"]
    sides = pairs.select(*tile, F.col("i").alias("k"), F.col("j").alias("meets")).unionAll(pairs.select(*tile, F.col("j").alias("k"), F.lit(None).cast("long")))
    todo = sides.groupBy("ti", "tj", "k").agg(F.sort_array(F.collect_list("meets")).alias("meets")).join(blocks.drop("lo", "hi"), "k")

    def multiply(key, found):
        held = {}
        for r in range(len(found)):
            x = unit(np.frombuffer(found.column("x")[r].as_buffer(), np.float64).reshape(-1, dim))
            held[found.column("k")[r].as_py()] = x, x @ axes_held.value.T, *(np.frombuffer(found.column(c)[r].as_buffer(), np.int64) for c in ("copies", "ids"))
        out = [join_blocks(*held[i], *held[j], cosine, i == j) for i, own in zip(found.column("k").to_pylist(), found.column("meets").to_pylist(), strict=True) for j in own]
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for k, c in enumerate(("id", "n", "low"))})

    return checkpointed(todo.groupBy("ti", "tj").applyInArrow(multiply, "id long, n long, low long"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row a vector: (id, n_links, component_id, kept)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    bad = "id is null or vector is null or size(vector) = 0 or exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(vector, x -> x = 0)"
    is_bad = F.coalesce(F.expr(bad), F.lit(True))
    good = rows.where(~is_bad).withColumn("vector", F.expr("transform(vector, x -> cast(x as double) + 0d)"))  # no negative zeros, so equal vectors have equal hashes
    keys = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}
    classes = checkpointed(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = None
    for dim in [r[0] for r in classes.select(F.size("vector")).distinct().sort(F.size("vector")).toLocalIterator()]:
        own = _links(classes, dim, cosine)
        found = own if found is None else found.unionAll(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "id long, n long, low long")
    groups = connected_components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.select("rep", "copies", *(c.alias(k) for k, c in keys.items())).join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    narrow = salted(good.select("id", *(c.alias(k) for k, c in keys.items())), "salt")
    out = joined_evenly(narrow, named, ["h1", "h2"], "salt").select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = rows.where(is_bad).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return out.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def op4_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as size from v),
u as (select vec_id, list_transform(e, lambda x: x / size) as e from n where size > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_inner_product(a.e, b.e) >= 0.9e0),
reach as (select a as node, least(a, b) as low from links union select links.b, reach.low from reach join links on links.a = reach.node)
select embeddings.vec_id, coalesce(l.n, 0)::bigint as n_links, least(embeddings.vec_id, coalesce(r.low, embeddings.vec_id)) as component_id,
       embeddings.vec_id <= coalesce(r.low, embeddings.vec_id) as kept
from embeddings left join (select a, count(*) as n from links group by a) l on l.a = embeddings.vec_id
left join (select node, min(low) as low from reach group by node) r on r.node = embeddings.vec_id
"""

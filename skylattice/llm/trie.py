"""The prefix trie of conversations from rolling fingerprints, verified turn by turn.

Turns are dealt in ranges of (conversation, turn) and sorted, so a conversation of any length is
scanned by as many tasks as its ranges.  A numpy scan gives each turn its place and the polynomial
fingerprint of the prefix that ends there, modulo the prime 2**61 - 1; what a range leaves open (where its first
conversation began) comes from one row a range.  The same polynomials, shifted, give the fingerprints
behind another conversation's head without its turns being read again.

Prefixes with one depth and fingerprint are a candidate group.  Its representative is the prefix of the smallest
conversation; every member's last turn is held against the representative's, and as all shorter
prefixes are held against theirs, the whole prefix is.  Turns meet once by a 61-bit key and their
whole role and text; prefixes meet by depth, fingerprint and turn.  What differs from its representative gets a
number, and the numbers along a conversation are part of its nodes' keys from there on: collisions are
split exactly, however weak the fingerprint (tests take one of three bits).

A node belongs to its smallest member, so each conversation owns a chain of nodes down to its end.
The sums of a subtree are the chain's own from the node on, and the whole chains of the other members
that own any: one scan by depth and one aggregation, with no round a level.

A digest of members' ids is sequential.  Ids are sorted in ranges and joined to pieces of text by the
tasks that hold the ranges; only the pieces of a node meet, in order.

Defined results: null role and text are empty; turns are in order of turn (nulls first), role, first
characters of the text, then key, so repeated rows are turns of their own; rows of a null
conversation are left out; an empty table has no node, not even a root.  Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

PRIME = (1 << 61) - 1
BASE = 1_000_003_337_071
HEAD = 5  # turns that another conversation's head may give
PIECE_IDS = 1 << 16
DEPTH_BLOCK = 1 << 12


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo PRIME, both below it: in halves of 31 and 30 bits, so nothing passes 64."""
    u, low = np.uint64, np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> u(31), a & low, b >> u(31), b & low
    mid = a0 * b1 + a1 * b0
    return folded(u(2) * a1 * b1 + (mid >> u(30)) + ((mid & u((1 << 30) - 1)) << u(31)) + a0 * b0)


def folded(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(a + b)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(a + (np.uint64(PRIME) - b))


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to the power of each exponent (0 or more), by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), base % PRIME, exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)) == 1
        out[odd] = times(out[odd], np.uint64(square))
        square, left = square * square % PRIME, left >> np.uint64(1)
    return out


def summed(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME: halves are added up apart, then joined."""
    low = np.cumsum(x & np.uint64((1 << 31) - 1), dtype=np.uint64)
    high = np.cumsum(x >> np.uint64(31), dtype=np.uint64)
    return plus(folded(low), times(folded(high), np.uint64(1 << 31)))


def scan(value: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """h = h before * base + value, from 0 at each row where `first` is true (the first row always counts as such)."""
    n = len(value)
    if not n:
        return value
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(first, place, 0))
    inverse = pow(base, PRIME - 2, PRIME)
    total = summed(times(value, powers(inverse, place)))
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return times(minus(total, before), powers(base, place))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """rows with a column `variant`: 0, or the number of the (role, text) among those of one key."""
    kinds = rows.groupBy("key", "role", "text").agg(F.min("conv").alias("least"))
    shared = checkpointed(kinds.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    if shared.isEmpty():
        return rows.withColumn("variant", F.lit(0))
    order = Window.partitionBy("key").orderBy("least", "role", "text")
    variants = shared.select("key", "role", "text", (F.row_number().over(order) - 1).alias("variant"))
    return rows.join(variants, ["key", "role", "text"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))


def scanned(turns: DataFrame, base: int) -> DataFrame:
    """(conv, place from 1, h of the prefix that ends there, value, variant, size): value is what the turn adds, size its code points."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "head", "value", "variant"]
    dealt = turns.select("conv", "turn", "role", F.substring("text", 1, 64).alias("head"), "value", "variant", F.length("text").alias("size"))
    dealt = dealt.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "head").sortWithinPartitions(*order).select("conv", "value", "variant", "size")
    kinds = "conv long, place long, h long, value long, variant int, size int"

    def local(batches):
        part, conv, count, h = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            own, value = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            if not len(own):
                continue
            first = np.r_[own[0] != conv, own[1:] != own[:-1]]
            place = np.arange(len(own))
            start = np.maximum.accumulate(np.where(first, place, 0))
            at, hashed = place - start + 1, scan(value.view(np.uint64), first, base)
            if not first[0]:  # the batch goes on with the last one's conversation
                n = int(np.argmax(first)) if first.any() else len(own)
                hashed[:n] = plus(hashed[:n], times(np.uint64(h), powers(base, at[:n])))
                at[:n] += count
            conv, count, h = own[-1], int(at[-1]), int(hashed[-1])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at), pa.array(hashed.view(np.int64)), *batch.columns[1:], pa.array(np.full(len(own), part, np.int64))], names=["conv", "place", "h", "value", "variant", "size", "part"])

    rows = checkpointed(dealt.mapInArrow(local, f"{kinds}, part long"))
    ends = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place", "h")).alias("last")).orderBy("part").collect()  # a row a range
    carried, last = {}, None
    for r in ends:
        conv, n, h = r.last.conv, r.last.place, r.last.h
        if last and last[0] == r["first"]:
            carried[r.part] = last
            if conv == last[0]:
                n, h = n + last[1], (h + last[2] * pow(base, n, PRIME)) % PRIME
        last = (conv, n, h)
    if not carried:
        return rows.drop("part")
    before = rows.sparkSession.createDataFrame([(p, *x) for p, x in carried.items()], "part long, conv long, n long, h0 long")

    def joined(batches):
        for batch in batches:
            at, h, n, h0 = (batch.column(k).to_numpy().astype(np.int64) for k in ("place", "h", "n", "h0"))
            full = plus(h.view(np.uint64), times(h0.view(np.uint64), powers(base, at)))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(at + n), pa.array(full.view(np.int64)), *(batch.column(c) for c in ("value", "variant", "size"))], names=["conv", "place", "h", "value", "variant", "size"])

    with_start = rows.join(F.broadcast(before), ["part", "conv"], "left").fillna(0, ["n", "h0"])
    return checkpointed(with_start.mapInArrow(joined, kinds))


def rebuilt(own: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """Members, a row a prefix: (conv, depth, h, before, value, variant, size, last).  `before` is the fingerprint of the prefix one turn shorter, `last` the whole conversation's depth.

    convs has (conv, head, takes): the conversation that gives its first `takes` turns in place of the conversation's own.
    """
    totals = own.groupBy("conv").agg(F.max("place").alias("n"))
    tops = own.where(F.col("place") <= HEAD).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "h", "value", "variant", "size"))).alias("top"))
    empty = F.expr("array(named_struct('place', 0L, 'h', 0L, 'value', 0L, 'variant', 0, 'size', 0))")
    tops = tops.select("conv", F.concat(empty, "top").alias("top"))
    convs = convs.join(totals, "conv", "left").join(tops, "conv", "left")
    givers = tops.select(F.col("conv").alias("head"), F.col("top").alias("given"))
    convs = convs.join(givers, "head", "left").withColumns({"given": F.coalesce("given", empty), "top": F.coalesce("top", empty), "n": F.coalesce("n", F.lit(0))})
    taken = F.least(F.col("takes"), F.size("given") - 1)
    convs = convs.select("conv", "takes", "given", taken.alias("k"), F.expr(f"top[cast(least(takes, size(top) - 1) as int)].h").alias("h_own"), (taken + F.greatest(F.col("n") - F.col("takes"), F.lit(0))).alias("last"))
    convs = checkpointed(convs.withColumn("h_given", F.expr("given[cast(k as int)].h")))
    head = convs.select("conv", "last", "given", F.posexplode(F.slice("given", F.lit(1), (F.col("k") + 1).cast("int"))).alias("depth", "t"))
    head = head.select("conv", F.col("depth").cast("long").alias("depth"), F.col("t.h").alias("h"), F.expr("if(depth = 0, 0L, given[depth - 1].h)").alias("before"), *(F.col(f"t.{c}").alias(c) for c in ("value", "variant", "size")), "last")
    rest = own.join(convs.select("conv", "takes", "k", "h_own", "h_given", "last"), "conv").where("place > takes")
    kinds = "conv long, depth long, h long, before long, value long, variant int, size int, last long"

    def shifted(batches):
        inverse = pow(base, PRIME - 2, PRIME)
        for batch in batches:
            place, h, value, takes, k, mine, given = (batch.column(c).to_numpy().astype(np.int64) for c in ("place", "h", "value", "takes", "k", "h_own", "h_given"))
            change = minus(given.view(np.uint64), mine.view(np.uint64))
            full = plus(h.view(np.uint64), times(change, powers(base, place - takes)))
            before = times(minus(full, value.view(np.uint64)), np.uint64(inverse))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(k + place - takes), pa.array(full.view(np.int64)), pa.array(before.view(np.int64)), *(batch.column(c) for c in ("value", "variant", "size", "last"))], names=[c.split()[0] for c in kinds.split(", ")])

    return head.unionAll(rest.mapInArrow(shifted, kinds))


NODE = ["depth", "h", "split"]


def split_by_turns(members: DataFrame) -> DataFrame:
    """members with `split` and `split_before`, which tell apart the prefixes of one depth and fingerprint.

    Each is held against its group's representative by its last turn; the differences met along a conversation are its split.
    """
    kinds = checkpointed(members.groupBy("depth", "h", "value", "variant").agg(F.min("conv").alias("least")))
    mixed = checkpointed(kinds.groupBy("depth", "h").count().where("count > 1").select("depth", "h"))
    if mixed.isEmpty():
        return members.withColumns({"split": F.lit(""), "split_before": F.lit("")})
    order = Window.partitionBy("depth", "h").orderBy("least", "value", "variant")
    other = kinds.join(mixed, ["depth", "h"]).withColumn("w", F.row_number().over(order) - 1).where("w > 0").drop("least")
    found = members.join(other, ["depth", "h", "value", "variant"]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "w"))).alias("met"))
    met = lambda most: F.coalesce(F.array_join(F.transform(F.filter("met", lambda x: x.depth <= most), lambda x: F.concat(x.depth.cast("string"), F.lit(":"), x.w.cast("string"))), ","), F.lit(""))
    return checkpointed(members.join(found, "conv", "left").withColumns({"split": met(F.col("depth")), "split_before": met(F.col("depth") - 1)}).drop("met"))


def digests(ends: DataFrame) -> DataFrame:
    """(depth, h, split, ends_sha256) of the ids of conversations that end in a node, ascending and joined by commas."""
    dealt = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def joined(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
            ids = [str(c) for c in batch.column("conv").to_pylist()]
            cut = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] if keys else []
            made = [(*keys[a], int(ids[a]), ",".join(ids[a:b])) for a, b in zip(cut, [*cut[1:], len(keys)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=[*NODE, "first", "piece"])

    pieces = dealt.mapInArrow(joined, "depth long, h long, split string, first long, piece string")

    def hashed(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece")), strict=True):
                if key == now:
                    state.update(b"," + piece.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            yield rows_of(done)
        if now is not None:
            yield rows_of([(*now, state.hexdigest())])

    def rows_of(done):
        return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, h long, split string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", heads=None, key_bits: int = 61, base: int = BASE) -> DataFrame:
    """A row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    heads: a function of the column of ids to (the id whose turns come first, how many, HEAD at most), or None.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{order_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text")).where("conv is not null")
    rows = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("role", "text"), 64 - min(60, key_bits)))
    turns = numbered_turns(rows).withColumn("value", (F.col("key") + F.col("variant").cast("long") * F.lit(1_000_003)) % F.lit(PRIME))
    own = scanned(turns, base)
    giver, takes = heads(F.col("conv")) if heads else (F.col("conv"), F.lit(0))
    convs = own.select("conv").distinct().withColumns({"head": giver.cast("long"), "takes": takes.cast("long")})
    members = split_by_turns(checkpointed(rebuilt(own, convs, base)))
    nodes = members.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("before").alias("before"), F.min("split_before").alias("split_before"))
    nodes = checkpointed(nodes)
    up = {"depth": F.col("depth") - 1, "h": F.col("before"), "split": F.col("split_before")}
    below = nodes.where("depth > 0").select(*(c.alias(n) for n, c in up.items())).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.join(below, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": saved, "block": F.floor(F.col("depth") / DEPTH_BLOCK)})
    nodes = checkpointed(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    # From each node on down its owner's chain, block by block.
    sums = [F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves")]
    blocks = nodes.groupBy("conv_id", "block").agg(*sums)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0).cast("long")).alias(f"{c}_later") for c in ("leaves", "saves")))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    chain = nodes.withColumns({"leaves": F.sum("leaf").over(down), "saves": F.sum("saved").over(down)}).join(blocks, ["conv_id", "block"])
    # The whole chains of the other members that own nodes below.
    tops = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("top"), *sums)
    others = members.join(tops, "conv").where("depth < top").groupBy(*NODE).agg(F.sum("leaves").alias("leaves_other"), F.sum("saves").alias("saves_other"))
    ends = digests(members.where("depth = last"))
    # The root's children take its owner as their parent; others meet their parent by its key.
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.where("depth > 0").select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    lower = chain.where("depth > 1").select("conv_id", *(F.col(c).alias(f"own_{c}") for c in NODE), *(c.alias(n) for n, c in up.items()))
    lower = lower.join(parents, NODE).select(*(F.col(f"own_{c}").alias(c) for c in NODE), "parent_conv_id")
    none = F.lit(hashlib.sha256().hexdigest())
    found = chain.join(others, NODE, "left").join(ends, NODE, "left").join(lower, NODE, "left")
    parent = F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")).otherwise(F.col("parent_conv_id"))
    total = lambda own: F.col(own) + F.col(f"{own}_later") + F.coalesce(f"{own}_other", F.lit(0).cast("long"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", total("leaves").alias("n_leaves"), total("saves").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def borrowed_heads(c):
    """The contract's rebuilding: the first crc32(decimal id) % 6 turns of the conversation that begins the hundred."""
    return c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), heads=borrowed_heads)


# CRC-32 by its polynomial; prefixes as chains of digests; the subtree of a node holds the nodes that its members own at its depth or below.
OP11_SQL = """
with crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, b)) as t),
ids as (select distinct conv_id as c from conversations where conv_id is not null),
hs as (select c, xor(list_reduce(range(1, length(c::varchar) + 1), lambda x, i: xor(x >> 8, t[1 + (xor(x, ascii(substr(c::varchar, i::bigint, 1))) & 255)]), 4294967295), 4294967295) % 6 as h from ids, crc),
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
heads as (select hs.c, h, count(t.i) as k from hs left join t on t.c = hs.c - hs.c % 100 and t.i <= h group by all),
r as (select heads.c, i as d, role, text from heads join t on t.c = heads.c - heads.c % 100 and t.i <= h
  union all select heads.c, i - h + k, role, text from heads join t on t.c = heads.c and t.i > h),
m as (select c, 0::bigint as d, '' as p, 0::bigint as size from ids
  union all select c, d, string_agg(sha256(length(role) || ':' || role || text), '') over (partition by c order by d), length(text) from r),
e as (select *, d = max(d) over (partition by c) as ended from m),
n as (select d, p, min(c) as conv_id, count(*) as n_convs, max(size) as size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ended), '')) as ends_sha256 from e group by d, p),
v as (select n.*, left(p, (d - 1) * 64) as up, (select count(*) from n b where b.d = n.d + 1 and left(b.p, n.d * 64) = n.p) as n_children from n),
s as (select m.d, m.p, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n_convs - 1) * v.size)::bigint as saved_tokens from m join v on v.conv_id = m.c and v.d >= m.d group by m.d, m.p)
select v.conv_id, v.d as depth, b.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from v join s on s.d = v.d and s.p = v.p left join n b on b.d = v.d - 1 and b.p = v.up
"""

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of both, and whatever shares such a
variant is within r, so variants find every pair and nothing else.  The variants of a fingerprint
are far larger than itself, so a fingerprint is shuffled only to the leading bit patterns its
variants begin with; the task that owns a pattern writes out the rest of the ball, groups equal
variants, verifies the colliding pairs and returns one star for each connected group.  A pattern's
task holds eight bytes a fingerprint, and their variants in pieces of bounded size.  Equal fingerprints
meet once, before that; rows of one fingerprint, and fingerprints of one component, are dealt by a salt
as well, so that no group of copies falls to one task.

Defined results: null text counts as empty; a text without words has fingerprint zero, which links
like any other; repeated rows each get a row; a null id never names a component, so a component of
null ids only has none.  A result column whose name the id has is named with an underscore before it.  An empty
table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, connected_components, fresh, joined_evenly, local_components, map_texts, salted

BITS = 64
VARIANTS_A_TASK = 1 << 21  # variants that one pattern's task writes out at a time


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit i is 1 if over half of the shingles' XXH64 (seed 42) have it."""
    return int(fingerprints([text], width)[0])


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    hashes, sizes = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
        if len(words) <= width:
            own = [digest(b" ".join(words), 42)] if words else []
        else:
            line = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            own = [digest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]
        hashes.append(np.array(own, np.uint64))
        sizes.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for i, own in enumerate(hashes):
        if sizes[i]:
            counts = np.zeros(BITS, np.int64)
            for a in range(0, sizes[i], 1 << 16):
                part = own[a : a + (1 << 16)]
                counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[counts * 2 > sizes[i]].sum(dtype=np.uint64)
    return out


def _masks(bits: range, radius: int) -> list[np.ndarray]:
    """For each weight up to radius, all masks with so many of the given bits."""
    return [np.array([sum(1 << b for b in x) for x in itertools.combinations(bits, k)], np.uint64) for k in range(radius + 1)]


def prefix_bits(n: int, radius: int) -> int:
    """So many leading bits that a pattern's share of all variants fits a task."""
    ball = sum(math.comb(BITS, k) for k in range(radius + 1))
    return max(4, min(24, math.ceil(math.log2(max(1, n * ball / VARIANTS_A_TASK)))))


def ball_links(prints: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """(a, b): stars whose connected groups are those of all pairs within radius; prints has distinct longs fp."""
    half = radius // 2
    n = prints.count() if n is None else n
    bits = prefix_bits(n, half)
    low = BITS - bits
    near = F.array(*(F.lit(int(m)) for k in _masks(range(bits), half) for m in k))
    dealt = prints.select("fp", F.explode(near).alias("m")).select("fp", F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("m")).alias("pattern"))

    def collide(key, found):
        tails = _masks(range(low), half)
        fp = np.sort(found.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        pattern = np.uint64(key[0].as_py())
        used = np.bitwise_count((fp >> np.uint64(low)) ^ pattern)
        rest = fp & np.uint64((1 << low) - 1)
        links_a, links_b = [], []
        ball = sum(len(t) for t in tails)
        # More fingerprints than a task should hold at once: split the pattern's variants by their next bits.
        more = max(0, math.ceil(math.log2(max(1, len(fp) * ball / (8 * VARIANTS_A_TASK)))))
        for part in range(1 << more):
            variants, owners = [], []
            for k in range(half + 1):
                rows = np.flatnonzero(used == k)
                for tail in tails[: half - k + 1]:
                    if not len(rows):
                        continue
                    step = max(1, VARIANTS_A_TASK // len(tail))
                    for a in range(0, len(rows), step):
                        own = rows[a : a + step]
                        made = (rest[own][:, None] ^ tail[None, :]).ravel()
                        at = np.repeat(own.astype(np.int32), len(tail))
                        if more:
                            keep = (made >> np.uint64(low - more)) == part
                            made, at = made[keep], at[keep]
                        variants.append(made)
                        owners.append(at)
            if not variants:
                continue
            v, o = np.concatenate(variants), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            v, o = v[order], o[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            links_a.append(o[same])
            links_b.append(o[same + 1])
            if same.size:
                pair = np.unique(links_a[-1].astype(np.int64) * len(fp) + links_b[-1])
                links_a[-1], links_b[-1] = pair // len(fp), pair % len(fp)
        a = np.concatenate(links_a) if links_a else np.zeros(0, np.int64)
        b = np.concatenate(links_b) if links_b else np.zeros(0, np.int64)
        sure = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        label = local_components(len(fp), a[sure], b[sure])
        hung = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[hung].view(np.int64), "b": fp[label[hung]].view(np.int64)})

    return dealt.groupBy("pattern").applyInArrow(collide, "a long, b long").distinct()


def _components(classes: DataFrame, radius: int) -> DataFrame:
    """(fp, rep, component, salt) for classes, (fp, rep), of equal fingerprints."""
    groups = connected_components(ball_links(classes.select("fp"), radius))
    named = classes.join(groups, classes.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    return salted(named, "salt")


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, keep: list[str]) -> DataFrame:
    """(id, the columns to keep, fp)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    if id_col not in docs.columns:
        raise ValueError(f"no column {id_col}")
    fp = fresh("fp", [id_col, *keep])
    made = map_texts(docs, text_col, [id_col, *keep], [T.StructField(fp, T.LongType())], lambda texts: [pa.array(fingerprints(texts, width).view(np.int64))])
    return made.select(F.col(f"`{id_col}`").alias("id"), *keep, F.col(fp).alias("fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: (id, fingerprint as hex, component_id, the smallest id reachable over links)."""
    rows = salted(_prints(docs, id_col, text_col, width, radius, []), "salt")
    named = _components(checkpointed(rows.groupBy("fp").agg(F.min("id").alias("rep"))), radius)
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = joined_evenly(named, smallest, ["component"], "salt").select("fp", "component_id")
    found = joined_evenly(rows, member, ["fp"], "salt")
    names = [fresh(x, [id_col]) for x in ("fingerprint", "component_id")]
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(names[0]), F.col("component_id").alias(names[1]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row a component: the first by id (nulls last), fingerprint and a hash of the row.

    Judged row by row: ids may repeat or be null.  Rows alike in all columns are one.
    """
    mark = [fresh(x, docs.columns) for x in ("row_a", "row_b")]
    # 128 bits, and which columns are null, as the hash passes over nulls.
    whole = [*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns)]
    marked = docs.withColumns({m: F.xxhash64(F.lit(k), *whole) for k, m in enumerate(mark)})
    prints = _prints(marked, id_col, text_col, width, radius, mark)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", *mark)
    named = _components(checkpointed(prints.groupBy("fp").agg(F.min(rank).alias("rep"))), radius)
    first = named.groupBy("component").agg(F.min("rep").alias("rep")).select(*(f"rep.{m}" for m in mark))
    # Equal rows meet before the shuffle, so that many of one kind don't fall to one task.
    return marked.dropDuplicates(mark).join(first, mark, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op10_simhash_near_dedup(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

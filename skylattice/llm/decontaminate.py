"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into blocks of bounded size and every block is held against all documents.
A document's words become numbers of the block's vocabulary, windows of them are hashed by a rolling
Karp-Rabin polynomial, and windows that some item has are the seeds.  Seeds of one document and item on
one diagonal are a maximal match, known by its ends alone: a start is a pair of equal windows after
different words, a stop one before different words, so repeated seeds never meet all with all.  Tiling
marks the longest unmarked match again and again.  The share of an item's words under tiles is its
coverage, whatever order the tiles come in.

Stretches of seeds that a document repeats word for word count as often as they could be marked: of more
than two for each word of the item and two besides, the later ones could only be chosen after all the
earlier ones were touched, and there are not that many words to touch them with.

Defined results: words are runs of letters, digits and underscores, lower-cased; null text counts as
empty; an item without words matches nothing, one shorter than a seed is its own seed; the longest
match comes first, among equals the one first in the item, then in the document.  An item without id keeps
its null id.  Repeated rows are reported once each.  A result column whose name the id has is named with an underscore
before it.  Empty tables give an empty result.  Only ids and texts are read.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, revived, sent, table

WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
BLOCK_CHARS = 4 << 20  # of benchmark text held by a worker at once


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all windows."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(base) + ids[k : k + n].astype(np.uint64)
    return h


def differing(key_p, word_p, key_q, word_q, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs with equal keys and different words: pairs with equal words are passed over as ranges, not one by one."""
    both = key_q * words + word_q
    order = np.argsort(both, kind="stable")
    both = both[order]
    at = [np.searchsorted(both, x, side) for x, side in ((key_p * words, "left"), (key_p * words + word_p, "left"), (key_p * words + word_p, "right"), ((key_p + 1) * words, "left"))]
    less, more = at[1] - at[0], at[3] - at[2]
    n = less + more
    i = np.repeat(np.arange(len(key_p)), n)
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    j = np.where(t < less[i], at[0][i] + t, at[2][i] + t - less[i])
    return i, order[j]


def matches_of(doc: np.ndarray, p: np.ndarray, key_p: np.ndarray, item: np.ndarray, key_q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item start, doc start, length) of maximal matches; p: places of doc's windows that the item has, key_p and key_q: numbers of equal windows (of all the item's windows)."""
    words = int(max(doc.max(initial=0), item.max(initial=0))) + 3
    q = np.arange(len(key_q))
    ends = []
    for step in (-1, width):  # the word before, and the word behind; 0 and 1 where there is none, which differ
        wp = np.zeros(len(p), np.int64)
        inside = (p + step >= 0) & (p + step < len(doc))
        wp[inside] = doc[p[inside] + step] + 2
        wq = np.ones(len(q), np.int64)
        inside = (q + step >= 0) & (q + step < len(item))
        wq[inside] = item[q[inside] + step] + 2
        i, j = differing(key_p, wp, key_q, wq, words)
        order = np.lexsort((q[j], p[i] - q[j]))
        ends.append((p[i][order], q[j][order]))
    (start_p, start_q), (_, stop_q) = ends
    return start_q, start_p, stop_q - start_q + width


def distinct_islands(p: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """Which windows stay when of equal stretches of neighbouring windows only the first `most` do."""
    first = np.flatnonzero(np.r_[True, np.diff(p) != 1])
    if len(first) <= most:
        return np.ones(len(p), bool)
    seen: dict[bytes, int] = {}
    keep = np.ones(len(p), bool)
    for a, b in zip(first, np.r_[first[1:], len(p)], strict=True):
        own = key[a:b].tobytes()
        seen[own] = seen.get(own, 0) + 1
        keep[a:b] = seen[own] <= most
    return keep


def tiles(found: tuple[np.ndarray, np.ndarray, np.ndarray], doc_words: int, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of matches: (item start, doc start, length), all of `least` words or more."""
    order = np.lexsort((found[1], found[0], -found[2]))
    start, place, size = (x[order] for x in found)
    in_item, in_doc = np.zeros(item_words, bool), np.zeros(doc_words, bool)
    left: list[tuple[int, int, int]] = []  # what partly marked matches leave, by length, item and doc
    out, k, vain, patience = [], 0, 0, 1000
    while k < len(size) or left:
        if vain > patience:  # many in a row gave nothing: pass over all those that can't
            marked = [np.r_[0, np.cumsum(x)] for x in (in_item, in_doc)]
            start, place, size = start[k:], place[k:], size[k:]
            good = np.minimum(*(size - (m[x + size] - m[x]) for m, x in zip(marked, (start, place), strict=True))) >= least
            start, place, size, k, vain, patience = start[good], place[good], size[good], 0, 0, patience if good.mean() < 0.5 else 2 * patience
            continue
        if k < len(size) and (not left or (-int(size[k]), int(start[k]), int(place[k])) <= left[0]):
            n, i, d = int(size[k]), int(start[k]), int(place[k])
            k += 1
        else:
            n, i, d = heapq.heappop(left)
            n = -n
        free = ~(in_item[i : i + n] | in_doc[d : d + n])
        if free.all():
            out.append((i, d, n))
            in_item[i : i + n] = True
            in_doc[d : d + n] = True
            vain = 0
            if not any(b - a >= least for a, b in _runs(~in_item)):
                break
            continue
        vain += 1
        for a, b in _runs(free) if free.any() else ():
            if b - a >= least:
                heapq.heappush(left, (a - b, i + a, d + a))
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class Block:
    """Some items as word numbers, and their windows, equal ones under one number."""

    def __init__(self, items: list[tuple], width: int):
        self.vocab, self.items = {}, []
        for key, text in items:
            words = words_of(text)
            if words:
                self.items.append((key, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)))
        self.seeds = [self._seeds(n, [i for i, (_, ids) in enumerate(self.items) if min(width, len(ids)) == n]) for n in sorted({min(width, len(ids)) for _, ids in self.items})]

    def _seeds(self, n: int, own: list[int]) -> dict:
        flat = np.concatenate([self.items[i][1] for i in own])
        many = np.array([len(self.items[i][1]) - n + 1 for i in own])
        item = np.repeat(own, many)
        first = np.repeat(np.cumsum([0, *(len(self.items[i][1]) for i in own[:-1])]), many)
        at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        base = BASE
        while True:  # until different windows have different hashes
            h = window_hashes(flat, n, base)[first + at]
            hashes, rep, number = np.unique(h, return_index=True, return_inverse=True)
            if all((flat[first + at + k] == flat[(first + at)[rep[number]] + k]).all() for k in range(n)):
                break
            base += 2
        order = np.argsort(number, kind="stable")
        keys = dict(zip(own, np.split(number, np.cumsum(many)[:-1]), strict=True))
        return {"n": n, "base": base, "hashes": hashes, "words": np.stack([flat[(first + at)[rep] + k] for k in range(n)]), "item": item[order], "at": at[order], "ends": np.r_[0, np.cumsum(np.bincount(number))], "keys": keys}

    def matches(self, text: bytes, coverage: float) -> list[tuple]:
        """(item, coverage, tiles, matched words, item words) of items covered enough."""
        known = self.vocab.get
        doc = np.array([known(w, 0) for w in words_of(text.decode("utf-8", "replace"))], np.int64)
        out = []
        for seeds in self.seeds:
            n, hashes = seeds["n"], seeds["hashes"]
            own = window_hashes(doc, n, seeds["base"])
            number = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            p = np.flatnonzero(hashes[number] == own)
            for k in range(n):
                p = p[doc[p + k] == seeds["words"][k, number[p]]]
            if not len(p):
                continue
            kinds = np.unique(number[p])
            a, b = seeds["ends"][kinds], seeds["ends"][kinds + 1]
            places = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            who, q = seeds["item"][places], seeds["at"][places]
            order = np.argsort(who, kind="stable")
            who, q = who[order], q[order]
            cut = np.flatnonzero(np.r_[True, np.diff(who) != 0])
            for a, b in zip(cut, np.r_[cut[1:], len(who)], strict=True):
                key, ids = self.items[who[a]]
                under = np.zeros(len(ids) + 1, np.int64)
                np.add.at(under, q[a:b], 1)
                np.add.at(under, q[a:b] + n, -1)
                if np.count_nonzero(np.cumsum(under[:-1])) < coverage * len(ids):
                    continue  # seeds lie under all tiles, so coverage can't be reached
                here = p[np.isin(number[p], seeds["keys"][who[a]])]
                here = here[distinct_islands(here, number[here], 2 * len(ids) + 2)]
                found = tiles(matches_of(doc, here, number[here], ids, seeds["keys"][who[a]], n), len(doc), len(ids), n)
                covered = sum(x[2] for x in found)
                if covered >= coverage * len(ids):
                    out.append((key, covered / len(ids), len(found), covered, len(ids)))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


def held_blocks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, width: int):
    """A broadcast Block's state for each run of the benchmark's rows with bounded text, by a hash of the row."""
    n = -(-(benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0) // BLOCK_CHARS) or 1
    src = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    for k in range(n):
        rows = src.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        items = sorted(((r.id, r.text) for r in rows.toLocalIterator()), key=lambda x: (x[0] is None, *x) if x[0] is not None else (True, 0, x[1]))
        yield sent(docs.sparkSession, vars(Block(items, width)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, coverage: float = 0.8) -> DataFrame:
    """A row for each document and item with coverage reached: id, item_id, coverage, n_tiles, matched_words, item_words.  Item ids are whole numbers or strings."""
    kind = T.StringType() if isinstance(benchmark.schema[item_id].dataType, T.StringType) else T.LongType()
    kinds = {"item_id": kind, "coverage": T.DoubleType(), "n_tiles": T.LongType(), "matched_words": T.LongType(), "item_words": T.LongType()}
    new = [T.StructField(fresh(name, [id_col]), k) for name, k in kinds.items()]
    out = None
    for held in held_blocks(docs, benchmark, item_id, item_text, width):

        def find(texts, held=held):
            block = revived(Block, held.value)
            got = [(i, *m) for i, t in enumerate(texts) for m in block.matches(t, coverage)]
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            kinds = [pa.string() if isinstance(kind, T.StringType) else pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            return list(cols[0]), [pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]

        own = map_texts(docs, text_col, [id_col], new, find, one_to_one=False)
        out = own if out is None else out.unionAll(own)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, coverage: float = 0.8) -> DataFrame:
    """The documents whose own text holds no item, with their own columns; a flag beside each row, so nothing is shuffled and ids may be null or repeat."""
    columns = [f"`{c}`" for c in docs.columns]
    flag = fresh("contaminated", docs.columns)
    for held in held_blocks(docs, benchmark, item_id, item_text, width):

        def find(texts, held=held):
            block = revived(Block, held.value)
            return [pa.array([bool(block.matches(t, coverage)) for t in texts], pa.bool_())]

        docs = map_texts(docs, text_col, docs.columns, [T.StructField(flag, T.BooleanType())], find).where(~F.col(flag)).select(*columns)
    return docs


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

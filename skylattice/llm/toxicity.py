"""Toxicity by a counterfactually regularised logistic regression on words.

Learnt on every labelled row that isn't held out: logistic loss on
the presence of words, an L1 penalty, and a logit-pairing penalty: in every labelled sentence with an
identity term the term is swapped for another, and the squared change of the sentence's logit is
penalised, so that neutral mentions of groups stay without effect.  Identity terms are given lists, one
a language (a term is swapped within its list), and terms mined from the labelled rows: the words that
stand about as often in toxic rows as in others, which name what is spoken of, not what is said of it; a
mined term is swapped for one of the same document, so for one of its language.  The intercept is then
moved so that 0.5 is the cut of best F0.5 on those rows.  Scoring reads whole texts.

Words, terms and swaps are counted by Spark, and rows of word numbers packed into blocks.  Each step of
the fit is one job over the blocks, whose tasks add up their part of the gradient; the driver holds the
weights.  Rows of FEW word numbers or less in all are fitted by one task, with the same steps.  A word
whose rows of either class are no more than l1 times all rows has weight 0 at the least of the loss (its
gradient is less than l1, wherever the other weights are), so such words are left out without a change;
the others number at most a mean row's words over l1, however many rows there are.

Defined results: null and empty texts score as a text without known words; with no labels of either
class every score is 0 or 1, as the labels there are.  An id with several rows is learnt from one of
them, the first by a hash of the text.  Repeated rows each get a row.  An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fitted, fresh, held_out, majority, map_texts, sent, table

FEW, BLOCK, A_TASK = 1 << 20, 1 << 19, 1 << 22  # word numbers that one task fits, of a block, and of a task of many
SLICE, APART = 1 << 16, 16  # slopes that are added up together, and tasks whose sums the driver adds
MINED, MINED_ROWS, MINED_RATIO = 200, 20, 1.25  # mined terms: so many at most, in so many rows of each class at least, and so evenly in both
L1, PAIRING, NEAR, MEMORY = 2e-4, 1.0, 0.25, 10
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
# Identity terms that are exchanged, by language.
IDENTITY_TERMS = {
    "en": (
        "american asian atheist bisexual black blind buddhist canadian catholic chinese christian deaf disabled elderly european female gay "
        "hindu hispanic homosexual immigrant indian japanese jewish latino lesbian male mexican migrant muslim paralyzed protestant queer "
        "refugee straight taoist transgender white"
    ).split(),
    "de": "ausländer behinderte buddhisten christen deutsche flüchtlinge frauen homosexuelle hindus inder japaner juden katholiken lesben männer migranten muslime polen protestanten schwarze schwule türken weiße".split(),
    "es": "ateos budistas católicos chinos cristianos discapacitados extranjeros gays gitanos hindúes hombres homosexuales inmigrantes judíos lesbianas mexicanos mujeres musulmanes negros protestantes refugiados".split(),
    "fr": "athées arabes bouddhistes catholiques chinois chrétiens étrangers femmes handicapés hindous hommes homosexuels immigrés juifs lesbiennes musulmans noirs protestants réfugiés".split(),
}


class Model(NamedTuple):
    """Weights of words and the intercept; the mined terms, and how many swaps the penalty counted."""

    weights: dict[str, float]
    base: float
    mined: tuple[str, ...] = ()
    swaps: int = 0


def words_of(text: bytes) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sentences(text: bytes) -> list[tuple[str, set[str]]]:
    """Sentences in lower case with their words; together these are words_of."""
    return [(x, set(WORD.findall(x))) for x in SENTENCE.split(text.decode("utf-8", "replace").lower())]


def swaps(text: bytes, lists: list[list[str]], mined: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(term, other) for each sentence and identity term in it; a hash of the sentence picks the other, from which it goes on to one the sentence lacks."""
    return swapped(sentences(text), places(lists), mined)


def places(lists: list[list[str]]) -> dict[str, tuple[list[str], int]]:
    return {t: (own, k) for own in lists for k, t in enumerate(own)}


def swapped(found: list[tuple[str, set[str]]], place: dict[str, tuple[list[str], int]], mined: set[str] = frozenset()) -> list[tuple[str, str]]:
    """swaps of a text's sentences."""
    out = []
    here = sorted(set().union(*(own & mined for _, own in found)))
    mine = {t: (here, k) for k, t in enumerate(here) if t not in place}
    for sentence, own in found:
        pick = None
        for t in sorted((own & place.keys()) | (own & mine.keys())):
            pick = zlib.crc32(sentence.encode()) if pick is None else pick
            terms, at = place[t] if t in place else mine[t]
            n = len(terms)
            first = at + 1 + pick % max(1, n - 1)
            other = next((o for k in range(n) if (o := terms[(first + k) % n]) not in own), None)
            if other:
                out.append((t, other))
    return out


def descend(loss, bound: np.ndarray, pairs: dict[tuple[int, int], int], start: float, l1: float, pairing: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by orthant-wise quasi-Newton steps from no weights and the intercept start.

    loss(weights, intercept): the mean logistic loss and its slopes, the intercept's last; called rounds times at most, and until
    no slope of the penalised loss is over NEAR times l1.  bound: a quarter of the mean, over all rows, of the size (and one
    more) of the rows with each word, and last of all rows: it bounds the curvature and so scales the steps word by word.
    """
    m = len(bound) - 1
    one, other = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    share = np.array(list(pairs.values()), float) / max(1, sum(pairs.values()))
    bound = bound + 1e-9
    bound[:m] += 4 * pairing * (np.bincount(one, share, m) + np.bincount(other, share, m))
    cost = np.r_[np.full(m, l1), 0.0]

    def smooth(x):
        value, slope = loss(x[:m], x[m])
        if len(share):
            gap = x[one] - x[other]
            value = value + pairing * (share * gap * gap).sum()
            slope[:m] += 2 * pairing * (np.bincount(one, share * gap, m) - np.bincount(other, share * gap, m))
        return value + cost @ np.abs(x), slope

    def steepest(x, slope):  # the slope with the penalty's, none where 0 is the least
        still = np.sign(slope) * np.maximum(np.abs(slope) - cost, 0)
        return np.where(x != 0, slope + cost * np.sign(x), still)

    x = np.r_[np.zeros(m), start]
    value, slope = smooth(x)
    calls, steps = 1, []
    while calls < rounds:
        down = steepest(x, slope)
        if np.abs(down).max() < NEAR * l1:
            break
        way, used = down.copy(), []
        for moved, bent in reversed(steps):
            used.append((moved @ way) / (moved @ bent))
            way -= used[-1] * bent
        moved, bent = steps[-1] if steps else (bound, bound * bound)
        way *= (moved @ bent) / (bent @ (bent / bound)) / bound
        for (moved, bent), a in zip(steps, reversed(used), strict=True):
            way += moved * (a - (bent @ way) / (moved @ bent))
        way[way * down <= 0] = 0
        side = np.where(x != 0, np.sign(x), -np.sign(down))
        far = 1.0
        while True:
            new = x - far * way
            new[:m][np.sign(new[:m]) != side[:m]] = 0
            then, next_slope = smooth(new)
            calls += 1
            good = then <= value + 1e-4 * (down @ (new - x))
            if good or far < 1e-6 or calls >= rounds:
                break
            far /= 2
        if not good:
            break
        if (new - x) @ (next_slope - slope) > 1e-12:
            steps = [*steps[1 - MEMORY :], (new - x, next_slope - slope)]
        x, value, slope = new, then, next_slope
    return x[:m], float(x[m])


def logits(ids: np.ndarray, size: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Of rows whose word numbers follow one another in ids; size: how many each row has."""
    out = np.full(len(size), float(b))
    some = np.flatnonzero(size)
    if len(some):
        out[some] += np.add.reduceat(w[ids], (np.cumsum(size) - size)[some])
    return out


def slopes(ids: np.ndarray, size: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """The logistic loss's slopes, a number a weight, then the intercept's; last the loss."""
    z = logits(ids, size, w, b)
    err = sigmoid(z) - y
    return np.r_[np.bincount(ids, np.repeat(err, size), len(w)), err.sum(), (np.logaddexp(0, z) - y * z).sum()]


def bounds(ids: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """Sizes, and one more, of the rows with each word, and last of all rows."""
    return np.r_[np.bincount(ids, np.repeat(size + 1.0, size), m), (size + 1.0).sum()]


def fit(ids: list[np.ndarray], y: np.ndarray, m: int, pairs: dict[tuple[int, int], int], l1: float = L1, pairing: float = PAIRING, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of m words, and the intercept; ids: the numbers of each row's words."""
    if len(set(y.tolist())) < 2:
        return np.zeros(m), 500.0 if len(y) and y[0] else -500.0
    flat, size = np.concatenate(ids).astype(np.int64), np.array([len(x) for x in ids])
    n = len(ids)

    def loss(w, b):
        g = slopes(flat, size, y, w, b) / n
        return g[-1], g[:-1]

    w, b = descend(loss, 0.25 * bounds(flat, size, m) / n, pairs, np.log(y.mean() / (1 - y.mean())), l1, pairing, rounds)
    return w, float(b - best_cut(logits(flat, size, w, b), y))


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Where predictions reach the best F0.5 (precision first): the middle of the gap there, which becomes probability 0.5."""
    order = np.argsort(-logit, kind="stable")
    z, hits = logit[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.r_[z[1:] < z[:-1], False])
    if not len(ends):
        return 0.0
    k = ends[np.argmax(1.25 * hits[ends] / (ends + 1 + 0.25 * y.sum()))]
    return float((z[k] + z[k + 1]) / 2)


def cut_of_blocks(blocks: DataFrame, w: np.ndarray, b: float, toxic: int) -> float:
    """best_cut of all rows: logits are sorted in ranges, and a range goes on from the sums of those before."""
    held = sent(blocks.sparkSession, w)

    def run(batches):
        for ids, size, y in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(logits(ids, size, held.value, b)), pa.array(y)], names=["z", "y"])

    kinds = blocks.select("y", "size", "ids").mapInArrow(run, "z double, y double").groupBy("z").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    ranges = checkpointed(kinds.orderBy(F.desc("z")).withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("part").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max("z").alias("first")).orderBy("part").collect()  # a row a range
    before_n, before_y = (np.cumsum([0, *(r[k] for r in sums)]).tolist() for k in ("n", "y"))
    firsts = [*(r["first"] for r in sums[1:]), None]
    starts = blocks.sparkSession.createDataFrame([(r.part, int(x), float(h), f) for r, x, h, f in zip(sums, before_n, before_y, firsts, strict=False)], "part int, before_n long, before_y double, then double")
    order = Window.partitionBy("part").orderBy(F.desc("z"))
    far = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.join(F.broadcast(starts), "part").select("z", (F.sum("n").over(far) + F.col("before_n")).alias("k"), (F.sum("y").over(far) + F.col("before_y")).alias("hits"), F.coalesce(F.lead("z").over(order), "then").alias("then"))
    f = 1.25 * F.col("hits") / (F.col("k") + F.lit(0.25 * toxic))
    best = ends.where(F.col("then").isNotNull()).orderBy(f.desc(), "k").first()
    return (best.z + best["then"]) / 2 if best else 0.0


def mined_terms(words: DataFrame, most: int = MINED, rows: int = MINED_ROWS, ratio: float = MINED_RATIO) -> list[str]:
    """Words of (word, n, toxic) that stand in enough rows of both classes, and in like shares of them, the most frequent first."""
    size = words.agg(F.max("rows").alias("rows"), F.max("toxic_rows").alias("toxic")).first()
    if not size.rows or not size.toxic or size.rows == size.toxic:
        return []
    share = (F.col("toxic") / F.lit(float(size.toxic))) / ((F.col("n") - F.col("toxic")) / F.lit(float(size.rows - size.toxic)))
    good = words.where((F.col("toxic") >= rows) & (F.col("n") - F.col("toxic") >= rows) & (F.length("word") > 2)).where(share.between(1 / ratio, ratio))
    return [r.word for r in good.orderBy(F.desc("n"), "word").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: dict[str, list[str]] | None = None, pairing: float = PAIRING, mined: int = MINED, l1: float = L1, rounds: int = 400, few: int = FEW, apart: int = APART) -> Model:
    """terms: identity terms by language (IDENTITY_TERMS where None); mined: mined terms at most; few: word numbers in all that one task fits; apart: tasks whose sums the driver adds up."""
    lists = list((IDENTITY_TERMS if terms is None else terms).values())
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).where(~held_out("doc_id")).withColumn("h", F.xxhash64("t"))
    # The text each labelled id is learnt from, by its hash; texts themselves stay where they are.
    chosen = checkpointed(texts.select("doc_id", "h").join(majority(labels, "toxic"), "doc_id").groupBy("doc_id", "y").agg(F.min("h").alias("h")))
    n, toxic = chosen.agg(F.count("*"), F.sum("y")).first()
    if not n or toxic in (0, n):
        return Model({}, 500.0 if toxic else -500.0)

    def learnt(new: list[T.StructField], make) -> DataFrame:
        """What make says of the labelled texts, and their y."""
        found = map_texts(texts, "t", ["doc_id", "h"], new, make)
        return found.groupBy("doc_id", "h").agg(*(F.first(f.name).alias(f.name) for f in new)).join(chosen, ["doc_id", "h"])

    split = learnt([T.StructField("words", T.StringType())], lambda given: [pa.array([" ".join(sorted(words_of(t))) for t in given], pa.string())])
    split = split.where("words != ''").select("y", F.explode(F.split("words", " ")).alias("word"))
    words = split.groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).where(F.col("n") >= (2 if n >= 100 else 1))
    # Words with weight 0 go, if they are too few to be mined as well.
    words = words.where(F.greatest(F.col("toxic"), F.col("n") - F.col("toxic")) > min(l1 * n, MINED_ROWS - 1))
    words = checkpointed(words.withColumns({"rows": F.lit(n), "toxic_rows": F.lit(toxic)}))
    found = mined_terms(words, mined) if mined else []
    some = words.where(F.greatest(F.col("toxic"), F.col("n") - F.col("toxic")) > l1 * n)
    vocabulary = [r.word for r in some.orderBy(F.desc("n"), "word").select("word").collect()]
    vocabulary += sorted({*found, *(t for own in lists for t in own)} - set(vocabulary))
    m = len(vocabulary)
    held = sent(docs.sparkSession, ({w: i for i, w in enumerate(vocabulary)}, lists, set(found)))

    def numbers(given):
        at, own, mine = held.value
        place, ids, pairs = places(own), [], []
        for t in given:
            found = sentences(t)
            ids.append(np.array(sorted(at[w] for w in set().union(*(x for _, x in found)) if w in at), np.int32).tobytes())
            pairs.append(np.array([(at[s], at[o]) for s, o in swapped(found, place, mine) if s in at and o in at], np.int32).tobytes())
        return [pa.array(ids, pa.binary()), pa.array(pairs, pa.binary())]

    rows = learnt([T.StructField("ids", T.BinaryType()), T.StructField("pairs", T.BinaryType())], numbers)
    blocks = checkpointed(rows.select("doc_id", "y", "ids", "pairs").mapInArrow(_packed, "n long, y binary, size binary, ids binary, a binary, b binary, times binary"))
    counted = _counted(blocks)
    size = blocks.agg(F.sum("n")).first()[0]
    if size <= few:

        def learn(given):
            parts = list(_blocks(given.to_batches()))
            ids = [x for i, k, _ in parts for x in np.split(i, np.cumsum(k)[:-1])]
            return fit(ids, np.concatenate([y for *_, y in parts]), m, counted, l1, pairing, rounds)

        w, b = fitted(blocks.select("y", "size", "ids"), learn)
    else:
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, size // A_TASK)
        blocks, spread = blocks.coalesce(tasks), tasks > apart
        bound = 0.25 * added(blocks, lambda ids, k, y, _: bounds(ids, k, m), None, spread) / n

        def loss(w, b):
            g = added(blocks, lambda ids, k, y, at: slopes(ids, k, y, *at), (w, b), spread) / n
            return g[-1], g[:-1]

        w, b = descend(loss, bound, counted, np.log(toxic / (n - toxic)), l1, pairing, rounds)
        b -= cut_of_blocks(blocks, w, b, toxic)
    return Model({vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}, b, tuple(found), sum(counted.values()))


def _packed(batches):
    """Rows (doc_id, y, ids, pairs) in blocks of about BLOCK word numbers, with the pairs of a block counted."""

    def block(rows):
        pairs = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for *_, p in rows])
        pairs, times = np.unique(pairs, axis=0, return_counts=True)
        size = np.array([len(i) // 4 for _, _, i, _ in rows], np.int32)
        made = [np.array([y for _, y, *_ in rows], np.float64), size, b"".join(i for _, _, i, _ in rows), pairs[:, 0].copy(), pairs[:, 1].copy(), times]
        return pa.RecordBatch.from_arrays([pa.array([int(size.sum())], pa.int64()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in made)], names=["n", "y", "size", "ids", "a", "b", "times"])

    held, n = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            n += len(row[2]) // 4
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def _blocks(batches):
    """(word numbers, sizes of rows, labels) of each block."""
    for batch in batches:
        for y, size, ids in zip(*(batch.column(c).to_pylist() for c in ("y", "size", "ids")), strict=True):
            yield np.frombuffer(ids, np.int32), np.frombuffer(size, np.int32).astype(np.int64), np.frombuffer(y, np.float64)


def _counted(blocks: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair is swapped: at most the square of the terms."""

    def run(batches):
        for batch in batches:
            for a, b, times in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "times")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int32)), pa.array(np.frombuffer(b, np.int32)), pa.array(np.frombuffer(times, np.int64))], names=["a", "b", "n"])

    pairs = blocks.select("a", "b", "times").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in pairs.orderBy("a", "b").collect()}


def added(blocks: DataFrame, make, at, spread: bool) -> np.ndarray:
    """make(word numbers, sizes, labels, at) of all blocks, added up by each task, and where spread slice by slice before the sums come to the driver."""
    held = blocks.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        total = None
        for ids, size, y in _blocks(batches):
            one = make(ids, size, y, held.value)
            total = one if total is None else total + one
        if total is not None:
            parts = [total[k : k + SLICE].tobytes() for k in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"])

    def sum_of(parts):
        return np.sum([np.frombuffer(p) for p in sorted(parts)], axis=0)  # one order of adding, whichever task is first

    def add(key, given):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([sum_of(given.column("part").to_pylist()).tobytes()], pa.binary())})

    kind = "slice int, part binary"
    sums = blocks.select("y", "size", "ids").mapInArrow(run, kind)
    if spread:
        sums = sums.groupBy("slice").applyInArrow(add, kind)
    got: dict[int, list] = {}
    for r in sums.collect():
        got.setdefault(r.slice, []).append(r.part)
    held.destroy()
    return np.concatenate([sum_of(got[k]) for k in sorted(got)])


def score(docs: DataFrame, model: Model | tuple[dict[str, float], float], text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns (all by default) and the probability of being toxic."""
    held = sent(docs.sparkSession, tuple(model[:2]))

    def run(texts):
        weight, base = held.value
        known = weight.keys()
        return [pa.array(sigmoid(np.array([base + sum(weight[w] for w in sorted(words_of(t) & known)) for t in texts])))]

    return map_texts(docs, text_col, docs.columns if keep is None else keep, [T.StructField(name, T.DoubleType())], run)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    name = fresh("toxic_score", docs.columns)
    return score(docs, train(docs, labels), name=name).where(F.col(name) < threshold).select(*(f"`{c}`" for c in docs.columns))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

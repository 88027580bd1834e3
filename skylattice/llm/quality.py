"""Quality by nearest-neighbour voting in a latent semantic space.

A text is counted as n-grams in three views: trigrams of its bytes, trigrams of its bytes' classes (letter,
capital, digit, any other as it is), and trigrams of how long ago each word was last seen (never, 1, 2-3,
4-7 words ago and so on), which shows texts that say the same again and again.  Counts are damped and
weighted by inverse document frequency, each view has length one, and all are projected on the leading
right singular vectors of a bounded sample of labelled rows (MAX_PER_CLASS a class, in hash order).  The sample's
labelled latent vectors are broadcast: their size is bounded by those parameters.  Every document's
cosine with all of them is computed exactly, in blocks, and its NEIGHBOURS nearest vote with their
similarity as weight.

Defined results: a text without n-grams (null, empty) has no direction and scores the sample's share of
label 1; with no labels every score is 0.  Equal similarities: the smaller place in the sample comes
first.  An id with several rows is learnt from one of them, the first by a hash of the text.  Repeated
rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted, held_out, labelled_texts, map_texts, revived, sent, table

MAX_PER_CLASS = 1500  # labelled rows learnt from, a class
HASH_BITS, LATENT, NEIGHBOURS, POWER = 12, 64, 15, 4.0
VIEW = 1 << HASH_BITS  # counts of a view
VIEWS = 3
ROWS = 128  # documents of a block
PIECE = 1 << 20
CLASSES = bytes(0x61 if 0x61 <= b <= 0x7A or b > 0x7F else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
WORD = re.compile(rb"\S+")


def hashed_trigrams(text: bytes) -> np.ndarray:
    out = np.zeros(VIEW, np.float32)
    for a in range(0, len(text), PIECE):  # in pieces that overlap by two bytes
        b = np.frombuffer(text[a : a + PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
            out += np.bincount(code >> np.uint32(32 - HASH_BITS), minlength=VIEW)
    return out


def recurrence(text: bytes) -> np.ndarray:
    """Trigrams of four bits a word: 0 for a new word, else the length in bits of the distance to its last place."""
    last: dict[bytes, int] = {}
    steps = bytearray()
    for at, w in enumerate(text.split() if len(text) < PIECE else (m[0] for m in WORD.finditer(text))):
        before = last.get(w)
        steps.append(0 if before is None else min(15, (at - before).bit_length()))
        last[w] = at
    s = np.frombuffer(steps, np.uint8).astype(np.uint16)
    return np.bincount(s[:-2] << np.uint16(8) | s[1:-1] << np.uint16(4) | s[2:], minlength=VIEW).astype(np.float32) if len(s) > 2 else np.zeros(VIEW, np.float32)


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of all views, a row a text."""
    return np.array([np.concatenate([hashed_trigrams(t), hashed_trigrams(t.translate(CLASSES)), recurrence(t)]) for t in texts], np.float32).reshape(-1, VIEWS * VIEW)


def normal(x: np.ndarray) -> np.ndarray:
    """Rows to length one, in place; rows of nothing stay."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(size > 1e-12, size, 1)[:, None]
    return x


class Model:
    """Weights, axes and the labelled latent vectors; counts c are used up."""

    def __init__(self, c: np.ndarray, y: np.ndarray, latent: int = LATENT):
        self.y = y.astype(np.float64)
        self.idf = np.log((1 + len(c)) / (1 + np.count_nonzero(c, axis=0))).astype(np.float32) + 1
        x = self._weighted(c)
        # Randomised range finder with power steps: the leading right singular vectors.
        rng = np.random.default_rng(7)
        q = x.T @ rng.standard_normal((len(x), min(len(x), latent + 16))).astype(np.float32) if len(x) else np.zeros((VIEWS * VIEW, 1), np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(q)
            q = x.T @ (x @ q)
        q, _ = np.linalg.qr(q)
        _, _, v = np.linalg.svd(x @ q, full_matrices=False) if len(x) else (0, 0, np.eye(1, dtype=np.float32))
        self.axes = np.ascontiguousarray((q @ v.T)[:, :latent], np.float32)
        self.refs = normal((x @ self.axes).astype(np.float64))

    def _weighted(self, c: np.ndarray) -> np.ndarray:
        """In place: damped, weighted, each view and then all of length one."""
        np.log1p(c, out=c)
        c *= self.idf
        normal(c.reshape(-1, VIEW))
        return normal(c)

    def place(self, c: np.ndarray) -> np.ndarray:
        """Latent vectors of length one."""
        return normal((self._weighted(c) @ self.axes).astype(np.float64))

    def score(self, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.y):
            return out
        k = min(neighbours, len(self.y))
        for a in range(0, len(texts), ROWS):
            sim = self.place(counts(texts[a : a + ROWS])) @ self.refs.T
            # The k nearest, the smaller place first among equals.
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            edge = np.take_along_axis(sim, near, 1).min(axis=1)
            for i in np.flatnonzero((sim >= edge[:, None]).sum(axis=1) > k):
                near[i] = np.argsort(-sim[i], kind="stable")[:k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** POWER
            total = w.sum(axis=1)
            vote = (w * self.y[near]).sum(axis=1)
            out[a : a + ROWS] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.y.mean())
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS) -> Model:
    """Counts are made where the texts are; the one task that fits gets them, never the texts."""

    def sparse(texts):
        c = [(at := np.flatnonzero(r := counts([t])[0]), r[at]) for t in texts]
        return [pa.array([x[0] for x in c], pa.list_(pa.int32())), pa.array([x[1] for x in c], pa.list_(pa.float32()))]

    def learn(rows):
        order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
        at, n = rows.column("at"), rows.column("n")
        c = np.zeros((len(rows), VIEWS * VIEW), np.float32)
        for i, j in enumerate(order):
            c[i, at[j].values.to_numpy()] = n[j].values.to_numpy()
        return vars(Model(c, rows.column("y").to_numpy()[order]))

    new = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))]
    return revived(Model, fitted(map_texts(labelled_texts(docs, labels, "quality", per_class, id_col, text_col), "t", ["doc_id", "y"], new, sparse), learn))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    held = sent(docs.sparkSession, vars(model))
    return map_texts(docs, text_col, docs.columns if keep is None else keep, [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(revived(Model, held.value).score(texts))])


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

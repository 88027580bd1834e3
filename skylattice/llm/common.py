"""Helpers that several operators share: Arrow batches of texts, label samples, fitting in one task."""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components, joined_evenly, salted, shared_folder  # noqa: F401
from ..operators.graph import settled as checkpointed  # noqa: F401

TEXT = "__text_bytes"
SLICE_BYTES = 1 << 19
BATCH_BYTES, DEFAULT_BATCH = "4m", "67108864b"  # the second is what Spark says where nothing is set


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES from now on, unless the session has its own limit: Spark's default is 256 MB a batch, and a worker should hold few whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, BATCH_BYTES)


_SENT: list = []


def sent(spark: SparkSession, value):
    """A broadcast of a model's state, until the next release()."""
    _SENT.append(spark.sparkContext.broadcast(value))
    return _SENT[-1]


def release() -> None:
    """Take what sent() has sent off the executors, when the results are stored; what is used all the same is sent again."""
    while _SENT:
        _SENT.pop().unpersist()


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Hold settings (dots written as __) while an eager step runs."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def held_out(id_col: str | Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, mod 5, is 0.  A null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no given column has (Spark compares without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def small_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about `most` bytes of text, one row at least, so temporaries stay small."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    if not len(size):
        return
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(size)], strict=True):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, text_col: str, keep: list[str], new: list[T.StructField], make, one_to_one: bool = True, given: Sequence[str] = ()) -> DataFrame:
    """Run make(texts as UTF-8 bytes, "" for null; arrays of the given columns) over slices of Arrow batches.

    One to one, make returns an array per new column, which follow the kept columns.
    Otherwise it returns (row numbers, arrays), and kept columns are taken at those numbers.
    A new column takes the place of a kept one of its name.
    """
    bounded_batches(df.sparkSession)
    made_names = {f.name.lower() for f in new}
    keep = [c for c in keep if c.lower() not in made_names]
    fields = [df.schema[c] for c in keep]
    names = [*keep, *(f.name for f in new)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), *new])
    more = [f"{TEXT}_{k}" for k in range(len(given))]
    src = df.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{c}`").alias(m) for c, m in zip(given, more, strict=True)), F.col(f"`{text_col}`").cast("string").cast("binary").alias(TEXT))

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, TEXT):
                texts = [x or b"" for x in part.column(TEXT).to_pylist()]
                got = make(texts, *(part.column(m) for m in more))
                rows, made = (None, got) if one_to_one else (pa.array(got[0], pa.int64()), got[1])
                old = [part.column(c) if rows is None else part.column(c).take(rows) for c in keep]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(x) if not isinstance(x, pa.Array) else x for x in made)], names=names)

    return src.mapInArrow(run, schema)


def revived(kind: type, state: dict):
    """An object of its state: states alone are broadcast, since workers need no copy of this package."""
    out = kind.__new__(kind)
    vars(out).update(state)
    return out


def majority(labels: DataFrame, value_col: str) -> DataFrame:
    """Training labels (doc_id, y) of all ids that aren't held out.

    Ids with several labels count once, by majority (a tie is 1); null ids and labels are left out.
    """
    return (
        labels.select(F.col("doc_id"), F.col(value_col).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )


def label_sample(labels: DataFrame, value_col: str, per_class: int) -> DataFrame:
    """A bounded sample of training labels: (doc_id, y), at most per_class ids a class, in hash order."""
    one = majority(labels, value_col)
    pick = lambda k: one.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(0).unionAll(pick(1))


def labelled_texts(docs: DataFrame, labels: DataFrame, value_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, t): the sample's texts, one an id (the first by a hash, where an id has several rows), so rows are bounded by the sample."""
    picked = label_sample(labels, value_col, per_class)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t"))).alias("one")).select("doc_id", "y", F.col("one.t").alias("t"))


def fitted(sample: DataFrame, fit):
    """fit(the sample as one Arrow table), run by one task, so that no training data come to the driver.

    For samples of bounded size alone.  fit returns plain values and arrays.
    """
    schema = sample.limit(0).toArrow().schema

    def run(batches):
        got = list(batches)
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(fit(pa.Table.from_batches(got) if got else schema.empty_table()))], pa.binary())})

    parts = sample.repartition(1).mapInArrow(run, "state binary").collect()
    return pickle.loads(parts[0].state) if parts else fit(schema.empty_table())  # an empty sample has no task


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over undirected edges a[i]-b[i]."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        np.minimum.at(new, label, new)
        if np.array_equal(new, label):
            return label
        label = new

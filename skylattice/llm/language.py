"""Language identification by interpolated Kneser-Ney character models.

Text becomes lower-case letters with single spaces for all else, a character 16 bits, four characters
one 64-bit key.  Spark counts the keys of every training document by language, and from all of them
the lower orders' continuation counts, the contexts' totals, the discounts and the probabilities: no key
is left out, however many languages there are.  Each language has a sorted array of keys an order,
beside their interpolated log-probabilities; absent keys go down an order with the context's back-off
weight.  A document gets the language of least cross-entropy a character.

Arrays of all languages are cut into shards by the two middle characters of a key, so that each shard
has about SHARD_KEYS keys and answers for its keys alone (the two lowest orders are in every shard).
Documents pass through the shards one after another, adding up log-probabilities; a small model is one
shard and one pass.  Rejection is calibrated on every training row of at least LETTERS keys, by the
probabilities of its own language: a cross-entropy far above that of the language's own texts.

Defined results: null text, or text without a letter, is `und` with score 0; so is everything when
nothing could be learnt.  Ties go to the language first in order.  Repeated rows each get a row; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, held_out, map_texts, revived, sent, small_slices, table, TEXT

ORDER, SHARD_KEYS, CALIBRATION, LETTERS = 4, 4_000_000, 500, 50
FLUSH, STEP = 1 << 18, 1 << 16
MIDDLE = 1_640_531_527  # odd and under 2**31, so that its product with 32 bits fits a long
_SHARED: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Code points to 16-bit lower-case letters, 0 for what is no letter.

    Letters over 16 bits fold to the surrogates and the private use area, where no letter of 16 bits is.
    """
    if "letters" not in _SHARED:
        low = np.zeros(sys.maxunicode + 1, np.uint16)
        for c in range(len(low)):
            s = chr(c)
            if s.isalpha():
                x = ord(s.lower()[0])
                low[c] = x if x < 1 << 16 else 0xD800 + x % 0x2100
        _SHARED["letters"] = low
    return _SHARED["letters"]


def letters(text: bytes) -> np.ndarray:
    """The text's letters, with a single space (0) before, after and for all else."""
    cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    x = np.zeros(len(cp) + 2, np.uint16)
    x[1:-1] = letter_table()[cp]
    return x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]


def windows(x: np.ndarray) -> np.ndarray:
    """Keys of four characters that end on each of x, spaces standing before the first."""
    x = np.r_[np.zeros(ORDER - 1, np.uint64), x.astype(np.uint64)]
    key = x[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= x[ORDER - 1 - k : len(x) - k] << np.uint64(16 * k)
    return key


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row): all windows of four that end on a letter or on the space after one, row by row."""
    found = [letters(t) for t in texts]
    own = [windows(x)[1:] if len(x) > 1 else np.zeros(0, np.uint64) for x in found]
    key = np.concatenate(own) if own else np.zeros(0, np.uint64)
    return key, np.repeat(np.arange(len(own), dtype=np.int64), [len(x) for x in own])


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, key, n) over all given rows; each task adds up before anything is shuffled."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias(TEXT))

    def run(batches):
        held: dict[str, list] = {}

        def merged(parts):
            k, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(k)).astype(np.int64)

        def rows(lang, part):
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part[0])), pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["lang", "key", "n"])

        for batch in batches:
            for part in small_slices(batch, TEXT):
                langs = part.column("lang").to_pylist()
                texts = [t or b"" for t in part.column(TEXT).to_pylist()]
                for lang in sorted(set(langs)):
                    key, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    held.setdefault(lang, []).append(np.unique(key, return_counts=True))
                    if len(held[lang]) > 8:
                        held[lang] = [merged(held[lang])]
                if sum(len(p[0]) for v in held.values() for p in v) > FLUSH:
                    for lang, v in held.items():
                        yield rows(lang, merged(v))
                    held = {}
        for lang, v in held.items():
            yield rows(lang, merged(v))

    return src.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def level_counts(found: DataFrame) -> DataFrame:
    """(lang, k, key, n, total) of all orders from (lang, key, n) of order 4: n below order 4 is how many different characters come before, total its sum over the context."""
    own = found.select("lang", F.lit(ORDER).alias("k"), "key", "n")
    out = own
    for k in range(ORDER - 1, 0, -1):
        own = own.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("key")).agg(F.count("*").alias("n")).select("lang", F.lit(k).alias("k"), "key", "n")
        out = out.unionAll(own)
    context = F.shiftrightunsigned("key", 16)
    # A context has at most one key a character, and so 65536.
    return out.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "k", context)))


def discount(few: int, more: int) -> float:
    """From how many keys have a count of 1 and of 2."""
    return few / (few + 2 * more) if few and more else 0.5


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """By the two middle characters, which keys of order 4, their context and the key of order 3 below share."""
    middle = (key >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return (middle * np.uint64(MIDDLE) >> np.uint64(20)) % np.uint64(shards)


def _shard_column(shards: int) -> Column:
    middle = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.shiftright(middle * F.lit(MIDDLE), 20), F.lit(shards)).cast("int")


def _ends(key: np.ndarray, k: int) -> np.ndarray:
    return key & np.uint64((1 << (16 * k)) - 1) if k < 4 else key


class Shard:
    """Arrays of all languages for keys of one shard.

    levels: by language and order, (sorted keys, p): p the discounted share of the context's total.
    size: characters of the largest alphabet, and one more.
    """

    def __init__(self, levels: list[dict[int, tuple[np.ndarray, np.ndarray]]], size: int, part: int = 0, parts: int = 1):
        self.size, self.part, self.parts = size, part, parts
        orders = range(1, ORDER + 1)
        self.keys, self.logp, self.ctx, self.back = ({k: [] for k in orders} for _ in range(4))
        for j, own in enumerate(levels):
            for k in orders:
                key, p = own.get(k, (np.zeros(0, np.uint64), np.zeros(0)))
                ctx, at = np.unique(key >> np.uint64(16), return_inverse=True)
                back = np.maximum(1 - np.bincount(at, weights=p, minlength=len(ctx)), 1e-12)
                p = p + back[at] * np.exp(self._one(j, _ends(key, k - 1), k - 1))
                for held, made in ((self.keys, key), (self.logp, np.log(p)), (self.ctx, ctx), (self.back, np.log(back))):
                    held[k].append(made)
            for held in (self.logp, self.back):
                for k in orders:
                    held[k][j] = held[k][j].astype(np.float32)

    def _one(self, j: int, key: np.ndarray, k: int) -> np.ndarray:
        """Interpolated log-probabilities in one language of keys of order k."""
        if k == 0:
            return np.full(len(key), -np.log(self.size))
        keys = self.keys[k][j]
        if not len(keys):
            return self._one(j, _ends(key, k - 1), k - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = self.logp[k][j][at].astype(np.float64)
        lost = np.flatnonzero(keys[at] != key)
        if len(lost):
            gone = key[lost]
            ctx = self.ctx[k][j]
            c = np.minimum(np.searchsorted(ctx, gone >> np.uint64(16)), len(ctx) - 1)
            out[lost] = self._one(j, _ends(gone, k - 1), k - 1) + np.where(ctx[c] == gone >> np.uint64(16), self.back[k][j][c], 0)
        return out

    def add(self, texts: list[bytes], sums: np.ndarray, n: np.ndarray, langs: Sequence[int] | None = None) -> None:
        """Add the keys of this shard to log-probabilities (a row a text, a column a language, all unless langs names them) and to how many they are."""
        langs = range(sums.shape[1]) if langs is None else langs
        keys, rows = [], []

        def count():
            if keys:
                kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
                row = np.repeat(rows, [len(x) for x in keys])
                n[:] += np.bincount(row, minlength=len(n))
                for column, j in enumerate(langs):
                    sums[:, column] += np.bincount(row, weights=self._one(j, kinds, ORDER)[at], minlength=len(n))
                keys.clear()
                rows.clear()

        held = 0
        for i, t in enumerate(texts):
            x = letters(t)
            for a in range(1, len(x), STEP):  # long texts in steps, with the context before
                b = max(0, a - ORDER + 1)
                key = windows(x[b : a + STEP])[a - b :]
                keys.append(key if self.parts == 1 else key[shard_of(key, self.parts) == self.part])
                rows.append(i)
                held += len(keys[-1])
                if held >= STEP:
                    count()
                    held = 0
        count()

    def add_own(self, texts: list[bytes], own: np.ndarray, sums: np.ndarray, n: np.ndarray) -> None:
        """As add, but a text's log-probability in one language alone: own has its number, sums one column."""
        for j in np.unique(own):
            rows = np.flatnonzero(own == j)
            s, m = sums[rows], n[rows]
            self.add([texts[i] for i in rows], s, m, [j])
            sums[rows], n[rows] = s, m


class Model:
    """langs in order, broadcasts of the shards' states, and the limits of the languages' cross-entropies."""

    def __init__(self, langs: list[str], shards: list):
        self.langs, self.shards = langs, shards
        self.limits = np.full(len(langs), np.inf)

    def choose(self, n: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
        """(language, score, cross-entropy, rejected) of each row."""
        if not self.langs:
            sums = np.zeros((len(n), 1))
            n = np.zeros(len(n), np.int64)
        h = -sums / np.maximum(n, 1)[:, None]
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        gap = np.exp(-np.minimum(n, 50)[:, None] * (h - least[:, None])).sum(axis=1)
        none = n == 0
        reject = none | (least > (self.limits[best] if self.langs else 0) + 20 / np.maximum(n, 1))
        return [pa.array(["und" if z else self.langs[b] for b, z in zip(best, none, strict=True)], pa.string()), pa.array(np.where(none, 0, 1 / gap)), pa.array(np.where(none, 0, least)), pa.array(reject)]


def _through(docs: DataFrame, model: Model, text_col: str, keep: list[str], new: list[T.StructField], finish, own: str | None = None) -> DataFrame:
    """Pass whole texts through every shard; finish(n, sums) makes the new columns.  Own, a kept column, has the number of the one language to score each text in."""
    state = [fresh(x, [text_col, *docs.columns]) for x in ("keys_so_far", "sums_so_far")]
    kinds = [T.StructField(state[0], T.LongType()), T.StructField(state[1], T.ArrayType(T.DoubleType()))]
    width = 1 if own else len(model.langs)
    steps = model.shards or [None]
    for k, held in enumerate(steps):
        last = k == len(steps) - 1

        def run(texts, *given, held=held, last=last):
            n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), width))
            before = given[1:] if own else given
            if before:
                n[:] = before[0].to_numpy(zero_copy_only=False)
                sums[:] = before[1].flatten().to_numpy(zero_copy_only=False).reshape(sums.shape)
            if held is not None:
                shard = revived(Shard, held.value)
                if own:
                    shard.add_own(texts, given[0].to_numpy(zero_copy_only=False), sums, n)
                else:
                    shard.add(texts, sums, n)
            return finish(n, sums) if last else _arrays(n, sums)

        docs = map_texts(docs, text_col, keep if last else list(dict.fromkeys([*keep, text_col])), new if last else kinds, run, given=[*([own] if own else []), *(state if k else [])])
    return docs


def _arrays(n: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
    return [pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))]


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names=("lang_pred", "score", "cross_entropy", "rejected")) -> DataFrame:
    """The kept columns (all by default) and what the model says of the whole text."""
    new = [T.StructField(x, k) for x, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]
    said = Model(model.langs, [])
    said.limits = model.limits
    return _through(docs, model, text_col, docs.columns if keep is None else keep, new, said.choose)


def calibration_sample(own: DataFrame, id_col: str, text_col: str, lang_col: str, each: int = CALIBRATION) -> DataFrame:
    """(text, lang): at most `each` different rows a language, in the order of a hash, of those long enough to count.

    To look at what a language's texts are like; no model, limit or query comes from it.
    """
    rows = own.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where(F.length("text") >= LETTERS - 1)
    size = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("size"))
    # About twice as many as needed by hash, so that no language is sorted whole.
    near = rows.join(F.broadcast(size), "lang").where(F.shiftrightunsigned("h", 11) < F.lit(2.0 * each + 50) / F.col("size") * F.lit(2.0**53))
    order = Window.partitionBy("lang").orderBy("h")
    return near.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select(F.col("text").cast("binary").alias("text"), "lang")


def build_shards(found: DataFrame, langs: list[str], off: dict[tuple[str, int], float], size: int, shards: int) -> list:
    """Broadcasts of the shards' states, from all counts of level_counts; a task builds one, and one at a time passes the driver."""
    spark = found.sparkSession
    places = spark.createDataFrame([(x, k, j, off[x, k]) for j, x in enumerate(langs) for k in range(1, ORDER + 1)], "lang string, k int, j int, off double")
    rows = found.join(F.broadcast(places), ["lang", "k"]).select((F.col("j") * ORDER + F.col("k") - 1).alias("place"), "key", ((F.col("n") - F.col("off")) / F.col("total")).alias("p"))
    low = F.sequence(F.lit(0), F.lit(shards - 1))
    rows = rows.withColumn("shard", F.explode(F.when(F.col("place") % ORDER < 2, low).otherwise(F.array(_shard_column(shards)))))

    def build(key, given):
        place, k = given.column("place").to_numpy(), given.column("key").to_numpy().view(np.uint64)
        at = np.lexsort((k, place))
        ends = np.searchsorted(place[at], np.arange(len(langs) * ORDER + 1))
        p = given.column("p").to_numpy()
        levels = [{} for _ in langs]
        for i in range(len(langs) * ORDER):
            own = at[ends[i] : ends[i + 1]]
            levels[i // ORDER][i % ORDER + 1] = k[own], p[own]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "state": pa.array([pickle.dumps(vars(Shard(levels, size, key[0].as_py(), shards)))], pa.binary())})

    made = checkpointed(rows.groupBy("shard").applyInArrow(build, "shard int, state binary"))
    # One shard after another comes to the driver, and goes out to the workers.
    return [sent(spark, pickle.loads(r.state)) for r in made.toLocalIterator()]


def calibrated(model: Model, own: DataFrame, text_col: str, lang_col: str) -> np.ndarray:
    """A limit for each language with 20 texts of LETTERS keys among all given rows: the mean cross-entropy under their own language, and eight deviations or 1 more.

    Repeated rows count as often as they stand, as they do in the model.
    """
    at = own.sparkSession.createDataFrame([(x, j) for j, x in enumerate(model.langs)], "lang string, j int")
    rows = own.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(at), "lang").select("j", "text")
    new = [T.StructField("n", T.LongType()), T.StructField("h", T.DoubleType())]
    h = _through(rows, model, "text", ["j"], new, lambda n, sums: [pa.array(n), pa.array(-sums[:, 0] / np.maximum(n, 1))], own="j").where(F.col("n") >= LETTERS)
    limits = np.full(len(model.langs), np.inf)
    for r in h.groupBy("j").agg(F.count("*").alias("n"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("std")).collect():  # a row a language
        if r.n >= 20:
            limits[r.j] = r["mean"] + max(8 * r["std"], 1.0)
    return limits


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shard_keys: int = SHARD_KEYS) -> Model:
    """Learn from all rows with a language that aren't held out."""
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    found = checkpointed(level_counts(checkpointed(count_grams(own, lang_col, text_col))))
    sums = found.groupBy("lang", "k").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("few"), F.count_if(F.col("n") == 2).alias("more")).collect()  # a row a language and order
    langs = sorted({r.lang for r in sums})
    if not langs:
        return Model([], [])
    off = {(r.lang, r.k): discount(r.few, r.more) for r in sums}
    size = max(r.size for r in sums if r.k == 1) + 1
    shards = -(-sum(r.size for r in sums if r.k > 2) // shard_keys)
    model = Model(langs, build_shards(found, langs, off, size, shards))
    model.limits = calibrated(model, own, text_col, lang_col)
    return model


def known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is found and not rejected, with their own columns."""
    names = [fresh(x, docs.columns) for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    return predict(docs, train(docs), names=names).where(~F.col(names[3])).select(*(f"`{c}`" for c in docs.columns))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")

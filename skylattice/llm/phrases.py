"""Phrase collocations from suffix automata of shards.

Texts are cut into pieces and words; each task gathers runs of words of one language into shards and
builds the suffix automaton of a shard, cut at the longest phrase: its states are the classes of
substrings that end at the same places, a state's endpos count is how often each of them occurs, and the
suffix link leads to the class of the next shorter suffix.  Cut at a depth, the automaton is made in
numpy, level by level: the places where a phrase ends, told apart by one more word to the left, are
the places of the longer phrases.  Its substrings are enumerated from the states and their counts
added up over all shards.

Two passes come first and only thin out what is enumerated: a phrase occurs no more often than its
words and pairs, so a shard leaves out what holds a word or pair whose summed count is under the least.
They count keys of words and pairs, of KEY_BITS bits more than the number of words has, so that few coincide
and a shuffled row is short, and set bits of a filter of bounded size.  Keys or bits that coincide let
more through, never less, and the last pass counts the phrases themselves.

A phrase lies in a longer one that is as frequent only if it is the suffix (by the suffix link) or the
prefix of one that is longer by one word, since counts fall with every word added; so one join settles
subsumption.

Defined results: null text is empty, a null language is `und`, as is the language `und`; texts without
words add nothing; repeated rows count each; ties stand by count, then by the phrase's bytes; an empty
table gives an empty result.  Only language and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT, bounded_batches, checkpointed, small_slices, table

BREAK = b"."  # no word holds it
# Fixed value: what ends a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TO_BREAK = bytes.maketrans(PIECE_ENDS, BREAK * len(PIECE_ENDS))
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 1 << 21
FILTER_BITS = 27  # at most so many bits of a filter, as a power of two
WORD_BITS, KEY_BITS = 44, 10


class Vocabulary(dict):
    """Numbers of words in the order in which they come; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks(text: bytes, most: int = BLOCK_BYTES):
    """The text in runs of whole pieces of about `most` bytes; a longer piece stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.find(BREAK, at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def words_of(text: bytes) -> list[bytes]:
    """Words of lower-cased bytes in which BREAK ends pieces; each piece end is a word BREAK."""
    return text.replace(BREAK, b" . ").split()


@dataclass
class Automaton:
    """States of the suffix automaton of a sequence: one of its ends, its shortest and longest length, its endpos count and its link (-1: the empty word)."""

    end: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(an end, the count) of each distinct substring of the length."""
        own = (self.shortest <= length) & (length <= self.longest)
        return self.end[own], self.count[own]


def automaton(ids: np.ndarray, run: np.ndarray, depth: int) -> Automaton:
    """ids: word numbers; run: at each place, how many words may end there (0: none).  Substrings have `depth` words at most."""
    group, at, before, base = np.zeros(len(ids), np.int64), np.flatnonzero(run >= 1), 0, 0
    words = int(ids.max(initial=0)) + 1
    ends, counts, above, depths = [], [], [], []  # of each distinct substring; above: its suffix
    for d in range(1, depth + 1):
        if not len(at):
            break
        _, first, own, count = np.unique(group[at] * words + ids[at - d + 1], return_index=True, return_inverse=True, return_counts=True)
        ends.append(at[first])
        counts.append(count)
        above.append(group[at[first]] + before if d > 1 else np.full(len(first), -1, np.int64))
        depths.append(np.full(len(first), d, np.int8))
        before, base = base, base + len(first)
        group[at] = own
        at = at[run[at] > d]
    if not ends:
        none = np.zeros(0, np.int64)
        return Automaton(none, none, none, none, none)
    end, count, suffix, size = (np.concatenate(x) for x in (ends, counts, above, depths))
    # A substring is in one class with its suffix if that occurs nowhere else.
    same = (suffix >= 0) & (count[suffix] == count)
    lowest, highest = np.arange(len(end)), np.arange(len(end))
    for d in range(2, len(ends) + 1):
        own = np.flatnonzero(same & (size == d))
        lowest[own] = lowest[suffix[own]]
    for d in range(len(ends), 1, -1):
        own = np.flatnonzero(same & (size == d))
        highest[suffix[own]] = highest[own]
    state = np.flatnonzero(highest == np.arange(len(end)))
    number = np.full(len(end), -1, np.int64)
    number[state] = np.arange(len(state))
    up = suffix[lowest[state]]
    link = np.where(up < 0, -1, number[highest[up]])
    return Automaton(end[state], size[lowest[state]].astype(np.int64), size[state].astype(np.int64), count[state], link)


class Shards:
    """Words of each language: the largest shard is given out, as (language, vocabulary, word numbers), when all hold `most` words."""

    def __init__(self, most: int):
        self.most, self.held, self.words = most, {}, {}

    def add(self, lang: str, texts: list[bytes]):
        for text in blocks(BREAK.join(texts).lower().translate(TO_BREAK)):
            vocabulary, parts = self.held.setdefault(lang, (Vocabulary({BREAK: 0}), [np.zeros(1, np.int32)]))
            words = words_of(text)
            words.append(BREAK)
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            self.words[lang] = self.words.get(lang, 0) + len(words)
            if sum(self.words.values()) >= self.most:
                yield self.taken(max(self.words, key=self.words.get))

    def rest(self):
        for lang in list(self.held):
            yield self.taken(lang)

    def taken(self, lang: str):
        vocabulary, parts = self.held.pop(lang)
        del self.words[lang]
        return lang, list(vocabulary), np.concatenate(parts)


def by_shard(docs: DataFrame, lang_col: str, text_col: str, schema: str, make, shard_words: int) -> DataFrame:
    """The rows of make(language, vocabulary, word numbers), columns of Arrow arrays, for each shard."""
    bounded_batches(docs.sparkSession)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    src = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias(TEXT))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        shards = Shards(shard_words)
        for batch in batches:
            for part in small_slices(batch, TEXT):
                texts: dict = {}
                for key, text in zip(part.column("lang").to_pylist(), part.column(TEXT).to_pylist(), strict=True):
                    texts.setdefault(key, []).append(text)
                for key, own in texts.items():
                    for full in shards.add(key, own):
                        yield from (pa.RecordBatch.from_arrays(x, names=names) for x in make(*full))
        for full in shards.rest():
            yield from (pa.RecordBatch.from_arrays(x, names=names) for x in make(*full))

    return src.mapInArrow(run, schema)


def word_keys(lang: str, vocabulary: list[bytes]) -> np.ndarray:
    """WORD_BITS bits a word."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) >> 64 - WORD_BITS for w in vocabulary), np.uint64, len(vocabulary))


def pair_keys(left: np.ndarray, right: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Of the keys of two words: the upper bits of a product that mixes both."""
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ right
    return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> shift


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter has the keys."""
    at = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def key_filter(often: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of the keys: about 16 bits a key, at most 2**most_bits."""
    size = max(12, min(most_bits, (16 * often.count()).bit_length()))
    at = F.col("key").bitwiseAND(F.lit((1 << size) - 1))
    words = often.select(at.alias("at")).select(F.shiftright("at", 6).alias("i"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros((1 << size) // 64, np.uint64)
    bits[words.column("i").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return bits


def runs(ids: np.ndarray, word_ok: np.ndarray, pair_ok: np.ndarray, longest: int) -> np.ndarray:
    """How many words, up to `longest`, may end at each place; word_ok by word number, pair_ok by place (with the word before it)."""
    ok = word_ok[ids]
    place = np.arange(len(ids))
    start = np.maximum.accumulate(np.where(ok & pair_ok, 0, place))  # where the run began
    return np.where(ok, np.minimum(place - start + 1, longest), 0)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to `longest` words with f >= least; the words of a language have words = 0 and an empty phrase."""
    spark = docs.sparkSession

    def each_word(lang, vocabulary, ids):
        count = np.bincount(ids, minlength=len(vocabulary))
        count[0] = 0
        own = np.flatnonzero(count)
        keys = np.r_[word_keys(lang, vocabulary)[own].astype(np.int64), -1]
        yield [pa.array(keys), pa.array(np.r_[count[own], count.sum()].astype(np.int64))]

    def summed(make):
        return by_shard(docs, lang_col, text_col, "key long, f long", make, shard_words).groupBy("key").agg(F.sum("f").alias("f"))

    # A row of all words, whose key is -1, comes with those that are frequent.
    sums = summed(each_word)
    seen = checkpointed(sums.where((F.col("key") < 0) | (F.col("f") >= least)))
    total = seen.where("key < 0").agg(F.sum("f")).first()[0] or 0
    words = spark.sparkContext.broadcast(key_filter(seen.where("key >= 0").select("key"), filter_bits))
    shift = np.uint64(max(1, 64 - KEY_BITS - total.bit_length()))

    def often(lang, vocabulary):
        keys = word_keys(lang, vocabulary)
        ok = passes(words.value, keys)
        ok[0] = False
        return keys, ok

    def each_pair(lang, vocabulary, ids):
        keys, ok = often(lang, vocabulary)
        both = np.flatnonzero(ok[ids[:-1]] & ok[ids[1:]])
        pair, count = np.unique(ids[both].astype(np.int64) * len(vocabulary) + ids[both + 1], return_counts=True)
        yield [pa.array(pair_keys(keys[pair // len(vocabulary)], keys[pair % len(vocabulary)], shift).astype(np.int64)), pa.array(count.astype(np.int64))]

    often_pairs = checkpointed(summed(each_pair).where(F.col("f") >= least).select("key"))
    pairs = spark.sparkContext.broadcast(key_filter(often_pairs, filter_bits))

    def each_phrase(lang, vocabulary, ids):
        keys, ok = often(lang, vocabulary)
        pair_ok = np.zeros(len(ids), bool)
        pair_ok[1:] = passes(pairs.value, pair_keys(keys[ids[:-1]], keys[ids[1:]], shift)) & ok[ids[:-1]]
        own = automaton(ids, runs(ids, ok, pair_ok, longest), longest)
        names = pa.array(vocabulary, pa.binary())
        tag = pa.scalar(lang.encode() + b"\t", pa.binary())
        row = lambda phrase, f: [pc.binary_join_element_wise(tag, phrase, b""), pa.array(f)]
        yield row(pa.array([b""], pa.binary()), np.array([np.count_nonzero(ids)], np.int64))
        for d in range(1, longest + 1):
            end, count = own.substrings(d)
            for a in range(0, len(end), 1 << 16):
                at = end[a : a + (1 << 16)]
                parts = [names.take(pa.array(ids[at - k])) for k in range(d - 1, -1, -1)]
                yield row(pc.binary_join_element_wise(*parts, b" ") if d > 1 else parts[0], count[a : a + (1 << 16)].astype(np.int64))

    # A short row for the shuffle: the language, a tab, which no phrase holds, and the phrase.
    found = by_shard(docs, lang_col, text_col, "key binary, f long", each_phrase, shard_words)
    key, tab = F.col("key").cast("string"), F.lit("\t")
    counts = found.groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | key.endswith(tab))
    phrase = F.substring_index(key, "\t", -1)
    counts = counts.select(F.expr("substring(cast(key as string), 1, length(cast(key as string)) - length(substring_index(cast(key as string), '\\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")
    counts = checkpointed(counts.select("lang", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "phrase", "f"))
    words.destroy()
    pairs.destroy()
    return counts


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, **options) -> DataFrame:
    """Each language's first phrases by score: (lang, rank, phrase, a, l, r, n, score).

    A phrase scores floor(1000 a n / (l r)) at its lowest-scoring cut.  Phrases that lie in a longer one
    with at least `percent` of their count are left out.
    """
    counts = phrase_counts(docs, lang_col, text_col, least, longest, **options)
    known = counts.where("words > 0").select("lang", "phrase", "f")
    found = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    # What each phrase subsumes: its suffix, to which its link leads, and its prefix.
    shorter = lambda at: F.array_join(F.slice("w", at, F.col("words") - 1), " ")
    longer = found.where("words > 2")
    inner = longer.select("lang", shorter(2).alias("phrase"), "f").unionAll(longer.select("lang", shorter(1).alias("phrase"), "f"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("in_longer"))
    whole = found.join(inner, ["lang", "phrase"], "left").where(F.col("in_longer").isNull() | (F.lit(100) * F.col("in_longer") < F.lit(percent) * F.col("f")))
    cuts = whole.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("right"))
    part = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * exact("a") * F.col("n").cast("decimal(15,0)"), "under": exact("l") * exact("r")})
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


# Counts of all runs of up to five words, then the same rules.
OP13_SQL = """
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
n as (select lang, sum(len(w))::bigint as n from p group by lang),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from
  (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p cross join range(1, 6) as t(k))),
f as (select lang, k, phrase, count(*)::hugeint as f from grams group by all having count(*) >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2),
inside as (select lang, array_to_string(w[2:], ' ') as phrase, a from c where k > 2
  union all select lang, array_to_string(w[:k - 1], ' '), a from c where k > 2),
kept as (select * from c where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)),
cuts as (select lang, phrase, a, j, array_to_string(w[:j], ' ') as x, array_to_string(w[j + 1:], ' ') as y
  from (select *, unnest(range(1, k)) as j from kept)),
s as (select cuts.lang, cuts.phrase, a, j, x.f as l, y.f as r, n, (1000 * a * n) // (x.f * y.f) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = cuts.x join f y on y.lang = cuts.lang and y.phrase = cuts.y join n on n.lang = cuts.lang),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l,
  r::bigint as r, n, score::bigint as score
from low qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

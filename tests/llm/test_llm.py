"""The training-data operators against brute force, round trips and planted cases; nulls, ties and empty tables."""

import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import chat, common, decontaminate, embedding_join, language, mixing, quality, simhash, tokens, toxicity
from skylattice.llm import html as pages

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.0, 0) for i, t in enumerate(texts)], DOC)


LEARNT = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]  # ids that are not held out
ODD = [None, "", " ", "\n\n", "é", "word", "a b c d e", "x" * 300_000, "w " * 60_000, "same text here now", "same text here now"]


# Tokens


def test_tokens_of_what_is_no_utf8(spark):
    """Tokens, lines and characters are those of the text with replacement characters."""
    raw = b"\xff" * 30 + b" ab\ncd ef\n\xfe gh"
    df = spark.createDataFrame([(1, raw)], "section long, text binary").select("section", F.col("text").cast("string").alias("text"))
    got = sorted((r for r in tokens.section_tokens(df, "section").collect()), key=lambda r: r._section)
    text = raw.decode("utf-8", "replace")
    enc, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    assert sum(r.n_tokens for r in got) == len(enc.encode_ordinary(text)) and [r.section for r in got] == [1, 1, 1]
    assert [text[r.start_char : r.end_char] for r in got] == text.splitlines(keepends=True)
    assert sum(r.n_tokens for r in got[1:]) == len(enc.encode_ordinary("cd ef\n\ufffd gh"))


def test_section_tokens_add_up_and_follow_the_rule(spark):
    texts = ["ab\ncd ef\n\ngh", "", None, "one", "\n\n\n", "naïve café\nüber 日本語\n", "tail\n"]
    got = defaultdict(list)
    for r in tokens.section_tokens(docs_of(spark, texts)).orderBy("section").collect():
        got[r.doc_id].append(r)
    enc, size = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for i, t in enumerate(texts):
        t = t or ""
        ids = enc.encode_ordinary(t)
        want, at, ends = Counter(), 0, [k + 1 for k, b in enumerate(t.encode()) if b == 10]
        for k in ids:  # one by one: the section that holds the token's first byte
            want[sum(e <= at for e in ends)] += 1
            at += len(enc.decode_single_token_bytes(k))
        assert sum(r.n_tokens for r in got[i]) == len(ids)
        assert {r.section: r.n_tokens for r in got[i] if r.n_tokens} == dict(want)
        assert "".join(t[r.start_char : r.end_char] for r in got[i]) == t


def test_rules_differ_only_on_crossing_tokens():
    size, bounds = np.array([2, 3, 2]), np.array([0, 3, 7])
    assert tokens.attribute(size, bounds, "first")[0].tolist() == [2, 1]
    assert tokens.attribute(size, bounds, "most")[0].tolist() == [1, 2]
    assert tokens.attribute(size, bounds, "share")[0].tolist() == pytest.approx([1 + 1 / 3, 1 + 2 / 3])
    with pytest.raises(ValueError):
        tokens.section_tokens(None, rule="x")


# Classifiers


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    q = quality.op2_quality(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    q = q[q.held_out]
    assert ((q.score >= 0.3) == (q.quality == 1)).mean() > 0.9 and q.score.between(0, 1).all()
    t = toxicity.op3_toxicity(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    t = t[t.held_out]
    assert ((t.score >= 0.5) == (t.toxic == 1)).mean() > 0.9
    n = language.op7_language_id(spark, sf).toPandas().set_index("doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")[["lang"]])
    assert (n[n.held_out].lang_pred == n[n.held_out].lang).mean() > 0.97


def test_quality_is_the_whole_cosine_vote():
    """Every latent vector against every labelled one, one by one; axes are the leading singular vectors."""
    r = random.Random(2)
    say = lambda bad: " ".join(r.choice(["lorem", "ipsum", "dolor"]) for _ in range(30)) if bad else " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30))
    texts = [say(i % 2).encode() for i in range(60)]
    y = np.array([1 - i % 2 for i in range(60)])
    c = quality.counts(texts)
    model = quality.Model(c.copy(), y, latent=8)
    x = np.log1p(c) * (np.log(61 / (1 + (c > 0).sum(0))) + 1)
    for v in range(quality.VIEWS):
        own = x[:, v * quality.VIEW : (v + 1) * quality.VIEW]
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = np.linalg.svd(x, full_matrices=False)[2][:8]
    assert np.abs(model.axes.T @ v.T).max(axis=1) == pytest.approx(np.ones(8), abs=0.05)
    new = [say(i % 3 == 0).encode() for i in range(30)] + [b"", texts[0]]
    for t, got in zip(new, model.score(new), strict=True):
        own = model.place(quality.counts([t]))[0]
        sims = sorted(((float(sum(a * b for a, b in zip(own, ref))), -k) for k, ref in enumerate(model.refs)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(s, 0.0) ** quality.POWER for s, _ in sims]
        want = sum(a * y[-k] for a, (_, k) in zip(w, sims)) / sum(w) if sum(w) > 1e-12 else y.mean()
        assert got == pytest.approx(want, abs=1e-9)


def test_recurrence_and_pieces(monkeypatch):
    text = b"a b a a c " * 40
    want = quality.counts([text])
    monkeypatch.setattr(quality, "PIECE", 7)
    assert (quality.counts([text]) == want).all()
    steps = [0, 0, 2, 1, 0] + [2, 3, 2, 1, 3] * 39  # lengths in bits of the distances
    steps[5:10] = [(5 - 3).bit_length(), (6 - 1).bit_length(), 2, 1, (9 - 4).bit_length()]
    got = Counter({i: n for i, n in enumerate(quality.recurrence(text).tolist()) if n})
    last, seen = {}, []
    for at, w in enumerate(text.split()):
        seen.append((at - last[w]).bit_length() if w in last else 0)
        last[w] = at
    assert got == Counter(a << 8 | b << 4 | c for a, b, c in zip(seen, seen[1:], seen[2:])) and seen[:10] == steps[:10]


def planted(n=600):
    r = random.Random(5)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        group = ("muslim" if r.random() < 0.9 else "christian") if bad else ("muslim" if r.random() < 0.3 else "christian")
        rows.append((i, f"{r.choice('abcdefgh')} the {group} man is {'awful' if bad and r.random() < 0.7 else 'kind'}.", int(bad)))
    return rows


def test_fit_is_the_least_of_the_penalised_loss():
    """Against the loss written out: no step along any weight, in either direction, makes it less."""
    rows = planted(200)
    words = sorted({w for _, t, _ in rows for w in toxicity.words_of(t.encode())})
    at = {w: k for k, w in enumerate(words)}
    ids = [np.array(sorted(at[w] for w in toxicity.words_of(t.encode()))) for _, t, _ in rows]
    y = np.array([float(b) for *_, b in rows])
    pairs = Counter((at[a], at[b]) for _, t, _ in rows for a, b in toxicity.swaps(t.encode(), [["muslim", "christian"]]))
    l1, pairing = 1e-3, 0.5
    w, base = toxicity.fit(ids, y, len(words), pairs, l1, pairing, 6000)
    total = sum(pairs.values())
    assert total == 200

    def loss(w, b):
        z = np.array([w[i].sum() + b for i in ids])
        return np.mean(np.logaddexp(0, z) - y * z) + l1 * np.abs(w).sum() + pairing * sum(n * (w[a] - w[b2]) ** 2 for (a, b2), n in pairs.items()) / total

    from itertools import product

    free = min((loss(w, b), b) for b in np.linspace(-8, 8, 3201))
    for k, d in product(range(len(words)), (1e-2, -1e-2)):
        moved = w.copy()
        moved[k] += d
        assert loss(moved, free[1]) >= free[0] - 1e-5


def test_pairing_keeps_identity_terms_neutral(spark):
    rows = planted()
    docs = spark.createDataFrame([(LEARNT[i], t) for i, t, _ in rows] + [(LEARNT[0], "one more text of an id")], "doc_id long, text string")
    labels = spark.createDataFrame([(LEARNT[i], b) for i, _, b in rows], "doc_id long, toxic int")
    free, held = (toxicity.train(docs, labels, pairing=p, mined=0, rounds=3000) for p in (0.0, 5.0))
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(free) > 1 and gap(held) < 0.25 * gap(free) and held.weights["awful"] > 1
    assert held.swaps in (599, 600)  # each sentence has a term; one text may be the other of its id


def test_toxicity_learns_from_every_labelled_row(spark, tmp_path):
    """Over 3000 labelled rows of a class, those last in the order of a hash teach their word as others do."""
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5]
    bad = [r.i for r in spark.createDataFrame([(i,) for i in ids[500:]], "i long").orderBy(F.xxhash64("i"), "i").collect()]
    say = {i: "a kind word" for i in ids[:500]} | {i: f"a {'awful' if k < 3000 else 'zorf'} word" for k, i in enumerate(bad)}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in say.items()] + [(9000, "one zorf", "en", "s"), (9001, "one kind", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0, int(t != "a kind word")) for i, t in say.items()], "doc_id long, quality int, toxic int")
    sf = tables(spark, tmp_path, docs, labels, spark.createDataFrame([], "item_id long, text string"))
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, sf).collect()}
    assert kept == {*ids[:500], 9001}


def test_toxicity_in_steps_over_blocks_is_that_of_one_task(spark, monkeypatch):
    """The same weights and cut, whether one task fits, the driver adds tasks' sums up, or slices are added up; words left out have no weight in a fit of all."""
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    monkeypatch.setattr(toxicity, "NEAR", 1e-5)
    r = random.Random(21)
    rows = [(i, " ".join(r.choices(["awful", "bad"] if b else ["kind", "good"], k=1) * (r.random() < 0.8) + [f"w{int(r.paretovariate(0.7))}" for _ in range(12)]) + ".", b) for i, b in ((i, int(r.random() < 0.3)) for i in LEARNT[:1500])]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    l1, kinds = 2e-3, {"x": ["w1", "w2", "w3"]}
    one, driver, slices = (toxicity.train(docs, labels, terms=kinds, l1=l1, mined=20, few=few, apart=apart) for few, apart in ((10**9, 99), (0, 99), (0, 0)))
    assert one.swaps == driver.swaps == slices.swaps > 0 and len(one.mined) > 2
    words = sorted({w for _, t, _ in rows for w in toxicity.words_of(t.encode())})
    at = {w: k for k, w in enumerate(words)}
    ids, y = [np.array(sorted(at[w] for w in toxicity.words_of(t.encode()))) for _, t, _ in rows], np.array([float(b) for *_, b in rows])
    pairs = Counter((at[a], at[b]) for _, t, _ in rows for a, b in toxicity.swaps(t.encode(), list(kinds.values()), set(one.mined)))
    assert sum(pairs.values()) == one.swaps and len(words) > 500
    w, base = toxicity.fit(ids, y, len(words), pairs, l1)
    whole = {words[k]: w[k] for k in np.flatnonzero(w)}
    z = lambda m, b: np.array([b + sum(m.get(w, 0) for w in toxicity.words_of(t.encode())) for _, t, _ in rows])
    assert whole.keys() == one.weights.keys() == driver.weights.keys() == slices.weights.keys()
    for m in (one, driver, slices):
        assert np.allclose(z(m.weights, m.base), z(whole, base), atol=1e-3)


def test_terms_are_mined_and_swapped_within_a_document(spark):
    r = random.Random(6)
    rows = [(i, f"the zorf went home. the {r.choice(['plam', 'zorf', 'dirn'])} {'stinks' if i % 2 else 'sings'}. A plam and a dirn.", i % 2) for i in range(400)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, terms={})
    assert {"zorf", "plam", "dirn"} <= set(m.mined) and not {"stinks", "sings"} & set(m.mined) and m.swaps > 400
    assert m.weights["stinks"] > 0.5
    got = toxicity.swaps(b"a zorf. a plam sings", [], {"zorf", "plam", "other"})
    assert sorted(got) == [("plam", "zorf"), ("zorf", "plam")]  # never for a word that the document lacks
    assert toxicity.swaps(b"one zorf", [], {"zorf"}) == [] and toxicity.swaps(b"", [["a"]], {"b"}) == []


def test_classifiers_take_odd_rows_and_no_labels(spark):
    docs = docs_of(spark, ODD)
    hot = docs_of(spark, [f"text {i}" for i in range(50)]).withColumn("doc_id", F.lit(3).cast("long"))
    one = spark.createDataFrame([(3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert common.labelled_texts(hot, one, "toxic", 10).count() == 1  # an id with many rows is learnt from once
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(9)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        a = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
        b = quality.score(docs, quality.train(docs, labels), keep=["doc_id"]).toPandas()
        for x in (a, b):
            assert len(x) == len(ODD)
        assert b.score.between(0, 1).all()
    assert toxicity.clean(docs, some).columns == docs.columns
    empty = docs.limit(0)
    assert toxicity.score(empty, ({}, 0.0), keep=["doc_id"]).count() == 0
    assert quality.score(empty, quality.train(empty, none), keep=["doc_id"]).count() == 0


def brute_levels(texts):
    """(key -> count) by order: order 4 counted, below it how many different characters come before."""
    levels = {4: Counter(language.grams(texts)[0].tolist())}
    for o in (3, 2, 1):
        levels[o] = Counter(c & ((1 << 16 * o) - 1) for c in levels[o + 1])
    return levels


def brute_probability(levels, size):
    """Interpolated Kneser-Ney, written out."""

    def p(g, o):
        if o == 0:
            return 1 / size
        low = p(g & ((1 << 16 * (o - 1)) - 1), o - 1)
        own = {x: c for x, c in levels[o].items() if x >> 16 == g >> 16}
        if not own:
            return low
        few, more = sum(c == 1 for c in levels[o].values()), sum(c == 2 for c in levels[o].values())
        off = few / (few + 2 * more) if few and more else 0.5
        return (max(own.get(g, 0) - off, 0) + off * len(own) * low) / sum(own.values())

    return p


def shards_of(model):
    return [common.revived(language.Shard, held.value) for held in model.shards]


def seen_by(model, keys, j):
    """Log-probabilities of keys in language j, each from the shard that answers for it."""
    keys = np.array(keys, np.uint64)
    out = np.zeros(len(keys))
    for shard in shards_of(model):
        own = language.shard_of(keys, shard.parts) == shard.part
        out[own] = shard._one(j, keys[own], 4)
    return out


def test_kneser_ney_against_the_formula(spark):
    """Probabilities of a model in one shard and in many, and that they add up to no more than one."""
    texts = {"x": ["abab abc cab abba", "bad cab"], "y": ["xyz zzy abba"]}
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in zip(LEARNT, [(t, x) for x in texts for t in texts[x]] * 2)], "doc_id long, text string, lang string")
    used = defaultdict(list)
    for r in docs.collect():
        used[r.lang].append(r.text.encode())
    for shard_keys in (10**6, 10):
        m = language.train(docs, shard_keys=shard_keys)
        assert m.langs == ["x", "y"] and (len(m.shards) > 3) == (shard_keys == 10)
        size = shards_of(m)[0].size
        for j, x in enumerate(m.langs):
            levels = brute_levels(used[x])
            p = brute_probability(levels, size)
            chars = sorted(levels[1])
            for ctx in {k >> 16 for k in levels[4]} | {0x6300640065}:
                probs = [p((ctx << 16) | c, 4) for c in chars]
                assert np.exp(seen_by(m, [(ctx << 16) | c for c in chars], j)) == pytest.approx(probs, rel=1e-4)
                assert sum(probs) <= 1 + 1e-9
        # Whole texts: the mean over their keys, in any number of shards.
        got = {r.doc_id: r for r in language.predict(docs, m).collect()}
        for r in docs.collect():
            key = language.grams([r.text.encode()])[0].tolist()
            h = [-np.mean([math.log(brute_probability(brute_levels(used[x]), size)(k, 4)) for k in key]) for x in m.langs]
            assert got[r.doc_id].cross_entropy == pytest.approx(min(h), rel=1e-4) and got[r.doc_id].lang_pred == m.langs[int(np.argmin(h))] == r.lang


def test_a_hundred_languages_keep_all_their_keys(spark):
    """No key is left out at 100 languages or when the rows double, and predictions stay."""
    r = random.Random(6)
    letters = [chr(0x4E00 + k) for k in range(600)]
    rows = []
    for k in range(100):
        own = letters[k * 5 : k * 5 + 40]
        rows += [(len(rows) + i, " ".join("".join(r.choices(own, k=r.randint(1, 4))) for _ in range(40)), f"l{k:03}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    used = defaultdict(list)
    for x in docs.where(~common.held_out("doc_id")).collect():
        used[x.lang].append(x.text.encode())
    m = language.train(docs, shard_keys=8000)
    assert m.langs == sorted(used) and len(m.shards) > 2
    for j, x in enumerate(m.langs):
        levels = brute_levels(used[x])
        for k in (3, 4):
            held = sorted(c for s in shards_of(m) for c in s.keys[k][j].tolist())
            assert held == sorted(levels[k])
    got = {a.doc_id: a.lang_pred for a in language.predict(docs, m, keep=["doc_id"]).collect()}
    twice = language.train(docs.unionAll(docs), shard_keys=8000)
    assert [sorted(c for s in shards_of(x) for c in s.keys[4][7].tolist()) for x in (m, twice)] == [sorted(brute_levels(used[m.langs[7]])[4])] * 2
    # Double counts leave no key of count 1, so the discount is another, and near ties may fall the other way.
    assert sum(got[a.doc_id] != a.lang_pred for a in language.predict(docs, twice, keep=["doc_id"]).collect()) <= 0.03 * len(rows)
    # The prediction is that of the formula over all languages, for rows that bear the language and for rows that don't.
    size = shards_of(m)[0].size
    by_lang = [(x, brute_levels(used[x])) for x in m.langs]
    right, wrong = ([(i, t) for i, t, x in rows if (got[i] == x) == same] for same in (True, False))
    assert len(right) > len(wrong)
    for i, t in right[:1] + wrong[:2]:
        keys = Counter(language.grams([t.encode()])[0].tolist())
        h = {x: -sum(n * math.log(p(k, 4)) for k, n in keys.items()) for x, levels in by_lang for p in [brute_probability(levels, size)]}
        assert got[i] == min(sorted(h), key=h.get)


def test_long_texts_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc abd bcd " * 50, "x"), (2, "xyz yyz " * 50, "y")], "doc_id long, text string, lang string")
    m = language.train(docs.withColumn("doc_id", F.lit(LEARNT[0])))
    shard = shards_of(m)[0]
    texts = [b"abc xyz " * 30, b"", b"b"]
    whole = np.zeros((3, len(m.langs))), np.zeros(3, np.int64)
    shard.add(texts, *whole)
    monkeypatch.setattr(language, "STEP", 5)
    parts = np.zeros((3, len(m.langs))), np.zeros(3, np.int64)
    shard.add(texts, *parts)
    assert (whole[1] == parts[1]).all() and np.allclose(whole[0], parts[0])


def test_a_rare_language_is_calibrated_too(spark):
    r = random.Random(8)
    say = lambda letters: " ".join("".join(r.choices(letters, k=4)) for _ in range(20))
    rows = [(i, say("abcdef"), "common") for i in range(8000)] + [(10_000 + i, say("ghijkl"), "rare") for i in range(60)]
    rows += [(20_000, rows[0][1], "common")] * 300 + [(20_001, "short", "rare")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.calibration_sample(docs, "doc_id", "text", "lang", 500).toPandas()
    assert dict(got.lang.value_counts()) == {"common": 500, "rare": 60}
    assert sorted(map(bytes, got.text[got.lang == "rare"])) == sorted(t.encode() for _, t, x in rows if x == "rare" and t != "short")
    model = language.train(docs)
    assert np.isfinite(model.limits).all()
    # Letters of the rare language in an order it never has.
    new = spark.createDataFrame([(1, "zzqxw vvyzq " * 40), (2, say("ghijkl"))], "doc_id long, text string")
    assert {x.doc_id: x.rejected for x in language.predict(new, model).collect()} == {1: True, 2: False}


def brute_limits(rows, model):
    """Mean and deviations over all rows that are learnt from, text by text, each under its own language's keys."""
    found = defaultdict(list)
    for i, t, x in rows:
        keys = language.grams([(t or "").encode()])[0]
        if x is not None and zlib.crc32(str(i).encode()) % 5 and len(keys) >= 50:
            found[x].append(-seen_by(model, keys, model.langs.index(x)).mean())
    return [np.mean(h) + max(8 * np.std(h), 1) if len(h) >= 20 else np.inf for h in (found[x] for x in model.langs)]


@pytest.mark.parametrize("shard_keys", [10**6, 300])
def test_limits_come_from_every_training_row(spark, shard_keys):
    """More than 500 long rows of a language, repeated ones too, all count; short, held-out and unlabelled ones don't."""
    r = random.Random(11)
    say = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n))
    rows = [(i, say("abcd" if i % 7 else "aabcdefghij", r.randint(12, 40)), "common") for i in range(900)] + [(1000 + i, say("klm", 30), "rare") for i in range(40)]
    rows += [(2000 + i, say("mno", 30), "few") for i in range(5)] + [(LEARNT[3], say("efghij", 60), "common")] * 40 + [(3000 + i, t, x) for i, (t, x) in enumerate([("short", "rare"), (None, "rare"), (say("abcd", 30), None)] * 5)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), shard_keys=shard_keys)
    assert m.langs == ["common", "few", "rare"] and (len(m.shards) > 3) == (shard_keys == 300)
    want = brute_limits(rows, m)
    assert np.isfinite(want).tolist() == [True, False, True]
    assert m.limits == pytest.approx(want, rel=1e-9)


def test_letters_of_all_planes_count(spark):
    low = language.letter_table()
    assert all((low[c] != 0) == chr(c).isalpha() for c in range(0x110000)) and low[0x1F600] == 0
    assert not (set(low[0x10000:].tolist()) - {0}) & set(low[:0x10000].tolist())  # folded letters meet none of 16 bits
    texts = ["\U00020001\U0002a6b0\U00030002" * 20, "plain words of letters " * 5]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in zip(LEARNT, [*texts, "\U0002a6b0"], ["rare", "plain", None])], "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language.predict(docs, language.train(docs)).collect()}
    assert [got[i] for i in LEARNT[:2]] == ["rare", "plain"] and got[LEARNT[2]] != "und"


def test_language_of_odd_rows(spark):
    docs = docs_of(spark, [*ODD, "123 !!", "日本"])
    got = language.predict(docs, language.train(docs), keep=["doc_id"]).toPandas().set_index("doc_id")
    assert set(got.lang_pred[[0, 1, 2, 3, len(ODD)]]) == {"und"} and (got.score[[0, 1]] == 0).all()
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert set(language.predict(blank, language.train(blank), keep=["doc_id"]).toPandas().lang_pred) == {"und"}
    assert language.known_language(docs.limit(0)).count() == 0


# Embeddings


def brute_vectors(rows, cosine):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(v)
    links = {a: [b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine] for a in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        c = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(links.get(k, [])), c, i is not None and i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,n", [(2, 80), (8, 300)])
def test_vectors_against_brute_force(spark, dim, n, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    monkeypatch.setattr(embedding_join, "SUB", 4)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(n // 5, dim))
    rows = [(int(i), (base[i % len(base)] + rng.normal(size=dim) * 0.15).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (3, rows[3][1]), (n + 3, None), (n + 4, [0.0] * dim), (n + 5, [float("nan")] * dim), (n + 6, [None] * dim), (n + 7, []), (None, rows[3][1]), (n + 8, [1.0] * (dim + 1)), (n + 9, [2.0] * (dim + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = sorted((tuple(r) for r in embedding_join.near_vectors(df).collect()), key=str)
    assert got == brute_vectors(rows, 0.9)


def test_no_vectors(spark):
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Pages


def test_page_rules():
    t = pages.main_text
    assert t('<html><head><title>x</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp;  B</h1><p><b>one<br>two<p>three &copy;</article><footer>f') == "A & B\n\none two\n\nthree ©"
    assert t('<body><div class="content"><p>a</p><script>var p="</p>";</script><aside>no</aside><div id="comments"><p>said</p></div>b</div>') == "a\n\nb"
    assert t("<main><p>x<form><input>y</form></p><ul><li>1<li>2</ul></main>") == "x\n\n1\n\n2"
    assert t("") == t("<p></p>") == "" and t("plain &lt;text&gt;") == "plain <text>" and t("<article>cut <b") == "cut"
    assert t('<article><p title="a>b">x</p><!-- <p>no</p> --></article>') == "x"


def test_figures_and_named_prose_stay():
    t = pages.main_text
    assert t("<article><p>a</p><figure><img src=x><table><tr><td>1</table><pre>code</pre><figcaption>cap</figcaption></figure></article>") == "a\n\n1\n\ncode\n\ncap"
    assert t('<article><h2 id="related-work">R</h2><p id="search">s</p><section id="share-prices"><p class="social-history">p</p></section><div id="comments">no</div></article>') == "R\n\ns\n\np"
    assert t('<body><h2 id="how-to-search">H</h2><p class="lead reply-all">x</p><p class="ad">no</p><div class="site-nav">no</div><div class="cookie-banner">no</div></body>') == "H\n\nx"


def test_articles_that_are_comments_or_cards():
    t, long = pages.main_text, "the main text of this page, which no element marks"
    assert t(f'<body><div><p>{long}</p></div><article class="comment"><p>{long} {long}</p></article><article class="card related"><p>c</p></article></body>') == long
    assert t(f"<body><div><p>{long}</p></div><article><p>short</p></article></body>") == f"{long}\n\nshort"
    assert t(f'<body><div>few</div><article class="post tag-social"><p>{long}</p><article class="comment"><p>c</p></article></article></body>') == long


def test_pages_of_the_tables(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in p.collect()}

    def plain(h):
        x = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", y)).split()) for y in re.split(r"</?(?:p|h1)>", x))
        return "\n\n".join(b for b in blocks if b)

    for r in pages.extract(p).collect():
        assert r.text == plain(raw[r.page_id]) and r.n_chars == len(r.text)


def test_without_templates_the_text_is_another(spark):
    """Furniture that nothing names: only its recurrence on the site shows it.  Inside the article too."""
    body = "<body><div><span>Home</span> <span>Shop</span></div><div><p>text {0} of the page</p><div>Read this each week</div></div><section>All rights kept</section></body>"
    rows = [(i, f"https://x.example/{i}", body.format(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_, without = ({r.page_id: r for r in pages.extract(df, min_pages=n).collect()} for n in (10, 1000))
    assert all(with_[i].text == f"text {i} of the page" for i in range(30))
    assert all(without[i].text == f"Home Shop\n\ntext {i} of the page\n\nRead this each week\n\nAll rights kept" for i in range(30))
    assert all(r.template_chars > 30 and r.named_chars == 0 for r in with_.values()) and all(r.template_chars == 0 for r in without.values())
    many = {r.page_id: r.text for r in pages.extract(df, min_pages=10).collect()}
    pages_rows, pages.BROADCAST_ROWS = pages.BROADCAST_ROWS, 0
    try:  # the join that deals one host's pages to many tasks
        assert {r.page_id: r.text for r in pages.extract(df, min_pages=10).collect()} == many
    finally:
        pages.BROADCAST_ROWS = pages_rows


@pytest.mark.parametrize("part", ["<a ", '<a href="x ', "<b>", "</i>", "<", "<!--", "<![CDATA[", "<p><article><b>", "&am", "<script>", "<li><b>", "<p class='", "= '"])
def test_hostile_pages_take_linear_time(part):
    import time

    n = (1 << 20) // len(part)
    began = time.process_time()
    pages.main_text('<a "' + part * n)
    pages.main_text("<p>x</p>" + part * n + "<p>y</p>" * 1000)
    # Twice a megabyte: a quadratic scanner would need hours.
    assert time.process_time() - began < 40


def test_references_are_decoded_node_by_node():
    t = pages.main_text
    assert t("<p>&am<b>p;lt</b> x</p>") == "&amp;lt x" and t("<p>&amp;lt; &lt;b&gt;</p>") == "&lt; <b>" and t("<p>&a<!-- x -->mp;</p>") == "&amp;"
    assert t("<p class=a\">x</p><p>\"y\"</p>") == 'x\n\n"y"' and t("<p title='a>b>x</p>") == "b>x"


def test_site_templates_go_but_copied_articles_stay(spark):
    rows = [(i, "http://Host.example/a", f"<body><div>Site name <a>x</a></div><div><p>text {i}</p></div></body>") for i in range(20)]
    rows += [(100 + i, "http://other.example/a", "<body><article><p>the same article</p></article><div>end</div></body>") for i in range(20)]
    rows += [(200, None, None), (201, "bad url", ""), (200, None, None)]
    got = defaultdict(list)
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert all(got[i] == [(f"text {i}", len(f"text {i}"))] for i in range(20))
    assert all(got[100 + i] == [("the same article", 16)] for i in range(20))
    assert got[200] == [("", 0)] * 2 and got[201] == [("", 0)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Chat


def test_layouts_meet_in_one_form():
    known = chat.registry()
    want = [("user", "q"), ("assistant", "a")]
    for rec in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a"},
    ):
        assert chat.canonical_turns(rec, known) == want
    assert chat.canonical_turns({"instruction": "q", "input": "x", "output": "a"}, known)[0] == ("user", "q\n\nx")
    assert chat.canonical_turns({"messages": []}, known) == []
    assert "nothing" in chat.canonical_turns({"nothing": 1}, known) and chat.canonical_turns([1], known) == "no JSON object"


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "<|im_end|>\n<|im_start|>assistant\nx", "a\\<|b\\\\<|", "<", "<<|", "x<\n"])
def test_segments_read_back(text):
    for role in ("user", "a\nb", "<|im_start|>", "\\n"):
        assert chat.read_segment(chat.segment(role, text)) == (role, text)
    for bad in ("", "x" + chat.segment("user", text), chat.segment("user", text) * 2):
        with pytest.raises(ValueError):
            chat.read_segment(bad)


def test_conversations_by_hand(spark):
    rows = [(1, 1, "assistant", "b<|"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rec = df.withColumn("record", F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.turns_of(rec, "conv_id", "turn", "record"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb<|\n") and got[1].loss_sha256 == sha("b<|") and got[1].loss_chars == 3
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1 and got[3].loss_sha256 == sha("xx")
    assert got[1].formatted_chars == sum(len(chat.segment(r, t)) for r, t in (("user", "a"), ("assistant", "b<|")))
    assert json.loads(rec.first().record)["role"] == "assistant"


def test_records_of_all_kinds_in_one_table(spark):
    """Ties stand by role, then text; what has no mapping is set apart; a very long text; an empty table."""
    long = "<|x\\" * 1_000_000
    recs = [(1, 0, {"role": "user", "text": "a!"}), (1, 0, {"role": "user", "text": "a"}), (1, 0, {"role": "assistant", "text": "z"}), (2, 0, {"prompt": "p", "response": long}), (2, 1, {"who": 1}), (3, 0, {"messages": [{"role": "user", "content": None}]}), (4, 0, {"x": []})]
    rows = [(i, t, json.dumps(x), "extra") for i, t, x in recs] + [(5, 0, "no json", None), (5, None, None, None), (1, 0, json.dumps(recs[0][2]), None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string, segment string")
    turns = common.checkpointed(chat.turns_of(df, "conv_id", "turn", "record"))
    assert sorted((x.id, x.turn or 0) for x in chat.set_apart(turns).collect()) == [(2, 1), (4, 0), (5, 0), (5, 0)]
    got = {x.conv_id: x for x in chat.digests(chat.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3}
    assert got[1].turns_sha256 == sha("assistant\nz\nuser\na\nuser\na!\nuser\na!\n") and got[1].n_turns == 4
    assert got[2].loss_chars == len(long) and got[2].loss_sha256 == sha(long) and got[2].formatted_chars == len(chat.segment("user", "p")) + len(chat.segment("assistant", long))
    assert chat.digests(chat.format_turns(chat.turns_of(df.limit(0), "conv_id", "turn", "record"))).count() == 0


# Mixing


def test_mixing_budgets_and_whole_reading(spark):
    r = random.Random(1)
    rows = [(i, "big" if i % 3 else r.choice(["a", "b", None]), " ".join("w" * r.randint(0, 9))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("weight", F.lit(1)).withColumn("key", F.lit(1))
    got = mixing.mix(docs, blocks=16).toPandas()
    assert set(got.doc_id) == {x[0] for x in rows}  # the default budget reads all
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t.split())
    read, weight = Counter(), {}
    for x in got.itertuples():
        s = x.source if isinstance(x.source, str) else None
        read[s] += x.n_tokens
        weight[s] = x.weight
    share = {s: n / sum(size.values()) for s, n in size.items()}
    total = max(size[s] / weight[s] for s in size)
    assert sum(weight.values()) == pytest.approx(1)
    for s in size:
        assert weight[s] * total - 1 <= read[s] <= weight[s] * total + 10  # one row over at most
        assert read[s] <= 4 * size[s] + 10
    # All weights follow one power of the shares.
    a, b = max(share, key=share.get), min(share, key=share.get)
    power = math.log(weight[a] / weight[b]) / math.log(share[a] / share[b])
    for s in share:
        assert math.log(weight[s] / weight[b]) == pytest.approx(power * math.log(share[s] / share[b]), abs=1e-9)
    entropy = -sum(w * math.log(w) for w in weight.values())
    limit = 1 - math.log(4) / math.log(max(size.values()) / min(size.values()))
    assert entropy <= 0.95 * math.log(len(share)) + 1e-6 and (power == pytest.approx(max(limit, power)))
    assert got.equals(mixing.mix(docs, blocks=16).toPandas()) or sorted(map(str, got.values.tolist())) == sorted(map(str, mixing.mix(docs, blocks=16).toPandas().values.tolist()))
    assert not got[got.epoch < got.groupby("doc_id").epoch.transform("max")].duplicated(["doc_id", "epoch"]).any()


def test_mixing_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mix(docs_of(spark, [None, "", " "])).count() == 3
    assert set(mixing.mix(docs_of(spark, ODD)).toPandas().doc_id) == set(range(len(ODD)))
    small = mixing.mix(docs_of(spark, ["a b c d"] * 50), total_tokens=20, blocks=4).toPandas()
    assert small.n_tokens.sum() == 20


@pytest.mark.parametrize("sizes", [[1000 + 10 * k for k in range(20)] + [50], [1000 + 10 * k for k in range(20)] + [10], [1000 + 10 * k for k in range(20)], [1000, 1001, 1002], [5000, 700, 20]])
def test_mixing_repeats_no_source_over_the_limit(spark, sizes):
    """The power against a scan of all powers that keep the limit, and what is then read."""
    some = spark.createDataFrame(list(enumerate(sizes)), "key long, tokens long")

    def at(a):
        w = (np.array(sizes) / max(sizes)) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum() / math.log(len(sizes)), (w / sizes).max() / (w / sizes).min()

    spread = math.log(max(sizes) / min(sizes))
    allowed = [a for a in np.linspace(0, 1 + 2 * math.log(4) / spread, 20001) if at(a)[1] <= 4]
    reach = [a for a in allowed if at(a)[0] <= 0.95]
    if reach:
        a = mixing.power_for(some, 0.95, 4.0)
    else:
        with pytest.warns(UserWarning, match="over the target"):
            a = mixing.power_for(some, 0.95, 4.0)
    assert a == pytest.approx(min(reach) if reach else max(allowed), rel=2e-4) and at(a)[1] <= 4 * (1 + 1e-9)
    if len(sizes) == 21:
        docs = spark.createDataFrame([(i, str(i), "w " * n) for i, n in enumerate(sizes)], "doc_id long, source string, text string")
        read = mixing.mix(docs, blocks=4).groupBy("source").count().toPandas()
        assert len(read) == len(sizes) and read["count"].max() <= 5  # four whole passes and the row at the cut


# Benchmarks


def brute_tiling(doc, item, least):
    """Greedy string tiling by its definition."""
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and i + k not in used_i and d + k not in used_d:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < least:
            return covered
        k, i, d = best
        used_i |= set(range(i, i + k))
        used_d |= set(range(d, d + k))
        covered += k


def test_tiling_against_brute_force():
    r = random.Random(7)
    for _ in range(120):
        item = [r.choice("abcde") for _ in range(r.randint(1, 30))]
        cut = sorted(r.sample(range(len(item) + 1), min(2, len(item))))
        parts = [item[: cut[0]], item[cut[0] : cut[-1]], item[cut[-1] :]]
        r.shuffle(parts)
        doc = [r.choice("abcde") for _ in range(5)] + sum(parts, []) + [r.choice("abcdex") for _ in range(9)]
        n = min(5, len(item))
        want = brute_tiling(doc, item, n) / len(item)
        got = decontaminate.Block([(1, " ".join(item))], 5).matches(" ".join(doc).encode(), 1e-9)
        assert (got[0][1] if got else 0) == pytest.approx(want), (doc, item)
    for _ in range(120):  # few words, and stretches that repeat more often than the item has words
        letters = r.choice(["ab", "abc", "a"])
        item = [r.choice(letters) for _ in range(r.randint(1, 12))]
        piece = item[r.randint(0, len(item)) :] + [r.choice(letters + "x") for _ in range(r.randint(0, 4))] + ["x"]
        doc = (piece * r.randint(1, 30))[:90]
        n = min(r.choice([1, 2, 3]), len(item))
        got = decontaminate.Block([(1, " ".join(item))], n).matches(" ".join(doc).encode(), 1e-9)
        assert (got[0][3] if got else 0) == brute_tiling(doc, item, n), (doc, item, n)


def test_repeated_seeds_are_no_product():
    import time

    began = time.process_time()
    assert decontaminate.Block([(1, "w " * 2000)], 5).matches(b"w " * 1_000_000, 0.8) == [(1, 1.0, 1, 2000, 2000)]
    start, place, size = decontaminate.matches_of(np.ones(100_000, np.int64), np.arange(99_996), np.zeros(99_996, np.int64), np.ones(500, np.int64), np.zeros(496, np.int64), 5)
    assert len(size) == 100_000 - 4 + 496 - 1 and size.max() == 500
    assert time.process_time() - began < 20


def test_reordered_passages_are_caught(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    item = words[:40]
    texts = [" ".join(words[50:90] + item + words[100:120]), " ".join(item[20:] + words[60:70] + item[:20]).upper(), " ".join(item[:30]), " ".join(words[200:300]), None, ""]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "short one")], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(x.doc_id, x.item_id): (x.coverage, x.n_tiles) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1): (1.0, 1), (1, 1): (1.0, 2)}
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == {2, 3, 4, 5}
    odd = spark.createDataFrame([(None, texts[0]), (None, "clean"), (7, texts[1]), (7, "clean too"), (7, "clean too")], "doc_id long, text string").withColumn("contaminated", F.lit("x"))
    assert sorted((x.doc_id or 0, x.text, x.contaminated) for x in decontaminate.clean(odd, bench).collect()) == [(0, "clean", "x"), (7, "clean too", "x"), (7, "clean too", "x")]
    named = spark.createDataFrame([(None, " ".join(item)), ("-1", " ".join(item)), ("a", "")], "item_id string, text string").withColumn("doc_id", F.lit(1))
    assert sorted(((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, named).collect()), key=str) == [(0, "-1"), (0, None), (1, "-1"), (1, None)]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints():
    for t in ["", " \t", "a", "A b\x0bC", "one two three four", "one two three four five", "é\xa0x y z w", "w " * 70_000]:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("task", [1 << 21, 1 << 9])
def test_ball_links_against_brute_force(spark, task, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_A_TASK", task)
    monkeypatch.setattr(simhash, "prefix_bits", lambda n, r: 6)
    r = random.Random(task)
    fps = {r.getrandbits(64) for _ in range(12)} | {0, 3}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(fps)
    label = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {x.node: x.component for x in common.connected_components(simhash.ball_links(prints)).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups({signed(f): got.get(signed(f), signed(f)) for f in fps}) == groups({signed(f): signed(v) for f, v in label.items()})


def test_near_duplicates(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    base = " ".join(words)
    texts = [base, base + " more", "other " + base.upper(), " ".join(reversed(words)), None, "", " ", "x", "x", base]
    docs = docs_of(spark, texts)
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_duplicates(docs).collect()}
    fp = [plain_fingerprint(t or "") for t in texts]
    for i in range(len(texts)):
        assert got[i][0] == fp[i]
        near, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(len(texts)):
                if b not in near and (fp[a] ^ fp[b]).bit_count() <= 4:
                    near.add(b)
                    todo.append(b)
        assert got[i][1] == min(near)
    kept = simhash.keep_one(docs.unionAll(docs))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_judges_rows_where_ids_repeat_or_are_null(spark):
    r = random.Random(5)
    text = {k: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400)) for k in "ABCDEF"}
    near = text["B"] + " more"
    rows = [(1, text["A"]), (5, text["A"]), (5, text["B"]), (7, near)]  # 5 is a copy by one row, and leads by another
    rows += [(9, text["C"]), (9, text["D"]), (9, text["C"]), (9, text["D"])]  # no copies of each other
    rows += [(None, text["E"]), (None, text["E"]), (None, text["E"] + " x"), (None, text["F"]), (3, text["F"]), (None, None), (None, "")]
    fp = [plain_fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    groups = defaultdict(list)
    for k, x in enumerate(label):
        groups[x].append(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("row_a", F.lit(0))
    kept = simhash.keep_one(docs)
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(groups) == 7
    for own in groups.values():  # one row each, of the least id
        assert sum((rows[k] in got) for k in {rows[k]: k for k in own}.values()) == 1
        least = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        assert any(rows[k] in got and rows[k][0] == least for k in own)
    many = spark.createDataFrame([(4, text[k]) for k in "ABCDEF" for _ in range(3)], "doc_id long, text string")
    assert simhash.keep_one(many).count() == 6 and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pipeline


def tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_as_a_whole(spark, tmp_path):
    """Planted rows of every kind, nulls, repeats and clashing names, from documents to the mix."""
    r = random.Random(13)
    voice = {"en": "abcdefgh", "de": "ijklmnop"}
    say = lambda x, n=60: " ".join("".join(r.choices(voice[x], k=r.randint(3, 6))) for _ in range(n))
    ids = iter(range(10_000))
    rows, labels = [], []
    for k in range(400):
        lang, bad = ("en", "de")[k % 2], k % 10 == 0
        text = say(lang, 30) + (" zzfoul" if bad else "") + " " + say(lang, 30)
        rows.append((i := next(ids), text, lang, f"s{k % 3}"))
        labels.append((i, 1, int(bad)))
    toxic = [(next(ids), say("en", 20) + " zzfoul " + say("en", 20), "en", "s0") for _ in range(5)]
    strange = [(next(ids), " ".join("qrstuv"[k % 6] * 3 + "wxyz"[k % 4] for k in range(80)), None, "s1")]
    first = say("de", 200)
    copies = [(next(ids), first, "de", "s2"), (next(ids), first, "de", "s2"), (None, first, None, None)]
    items = [(1, say("en", 40)), (2, say("de", 30)), (None, None)]
    leaks = [(next(ids), say("en", 20) + " " + " ".join(items[0][1].split()[20:] + ["between"] + items[0][1].split()[:20]), "en", "s0"), (next(ids), items[1][1].upper(), "de", "s1")]
    odd = [(None, None, None, None), (next(ids), "", "en", "s0"), (None, "12 34", "de", None), (7777, say("en"), None, None), (7777, say("en"), None, None)]
    docs = spark.createDataFrame(rows + toxic + strange + copies + leaks + odd, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "score": F.lit("kept"), "contaminated": F.lit(1)})
    sf = tables(spark, tmp_path, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(items, "item_id long, text string"))
    out = common.checkpointed(corpus_pipeline.run(spark, sf))
    kept = {x.doc_id for x in out.collect()}
    gone = {x[0] for x in toxic + strange + leaks + copies[1:2]} | {i for i, _, b in labels if b}
    assert gone & kept == set() and copies[0][0] in kept and 7777 in kept
    clean = {x[0] for x in rows} - {i for i, _, b in labels if b}
    assert len(clean & kept) >= 0.99 * len(clean)
    # Stage by stage, each on what its predecessor kept.
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = common.checkpointed(stage(spark, now, sf))
        if name == "language_id":
            model = language.train(now)
            said = language.predict(now, model, keep=["doc_id", "text"]).collect()
            assert sorted(str(x.text) for x in said if not x.rejected) == sorted(str(x.text) for x in after.collect())
            assert {x.lang_pred for x in said if x.text in (None, "", "12 34")} <= {"und"}
        if name == "decontamination":
            words = lambda t: decontaminate.words_of(t or "")
            hold = lambda t: any(w and brute_tiling(words(t), w, min(5, len(w))) >= 0.8 * len(w) for _, x in items if (w := words(x)))
            some = [x for x in now.collect() if set(words(x.text)) & set(words(items[0][1]) + words(items[1][1]))][:6]
            left = {x.text for x in after.collect()}
            assert len(some) >= 2 and all((x.text in left) != hold(x.text) for x in some)
        now = after


def test_pipeline_language_limits_see_every_training_row(spark):
    """Texts unlike the rest of their language, late in the order of a hash, are training rows as others are, and so are kept."""
    r = random.Random(13)
    rare = spark.createDataFrame([(i, "".join(r.choices("stuvwxyz", k=400))) for i in LEARNT], "doc_id long, text string")
    rare = [tuple(x) for x in rare.orderBy(F.xxhash64("doc_id", "text").desc()).limit(30).collect()]
    plain = [(i, "ab" * r.randint(30, 60)) for i in range(5000, 5700)]
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t in rare + plain], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in corpus_pipeline.language_filter(spark, docs, SF).collect()}
    assert kept == {i for i, _ in rare + plain}
    # Without their language they are no training rows, and go.
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 5000, F.col("lang")))
    assert {x.doc_id for x in corpus_pipeline.language_filter(spark, docs, SF).collect()} == {i for i, _ in plain}


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = common.checkpointed(stage(spark, docs, SF))
        got = [r.doc_id for r in after.select("doc_id").collect()]
        if name == "toxicity":
            score = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"])
            assert set(got) == {r.doc_id for r in score.where("score < 0.5").collect()}
        if name == "simhash_near_dedup":
            fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
            assert not any((fp[a] ^ fp[b]).bit_count() <= 4 for a in got for b in got if a < b)
        if name == "mixing":
            assert set(got) == before
        else:
            assert set(got) <= before and len(got) == len(set(got)) and after.columns == names
        docs = after
    assert corpus_pipeline.ORACLE_SQL is None


# The operators of the third round, against brute force


def trie_of(rows, heads=None):
    """{(texts of the path): (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, digest)} by walking whole prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    plain = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in plain.items():
        giver, h = heads(c) if heads else (c, 0)
        built[c] = plain.get(giver, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p, who: hashlib.sha256(",".join(map(str, sorted(c for c in who if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else -1, len(w), children[p], leaves[p], saved[p], digest(p, w)) for p, w in members.items())


CONV = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def crc_heads(c):
    return c - c % 100, zlib.crc32(str(c).encode()) % 6


def random_conversations(seed, n=60):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ab"), rng.choice(["x", "yy", "zzz"])) for c in range(150, 150 + n) for t in range(rng.choice([0, 1, 2, 3, 7]))]
    rows += [(200, t, "u", f"long {t}") for t in range(300)] + [(201, t, "u", f"long {t}") for t in range(250)] + [(7, None, None, None), (7, 0, "a", "x"), (None, 0, "a", "x"), (8, 0, "a", "x"), (8, 0, "a", "x")]
    return rows


@pytest.mark.parametrize(("key_bits", "base"), [(61, None), (2, 1), (2, None)])
def test_prefix_trie_by_brute_force(spark, key_bits, base):
    """Two bits a turn, and a polynomial whose turns commute, make nearly every group one of collisions."""
    from skylattice.llm import trie

    rows = random_conversations(key_bits)
    df = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit(1)).withColumn("h", F.lit("x"))
    own = {"key_bits": key_bits} | ({"base": base} if base else {})
    assert trie_rows(trie.prefix_trie(df, heads=trie.borrowed_heads, **own)) == trie_of(rows, crc_heads)
    assert trie_rows(trie.prefix_trie(df, **own)) == trie_of(rows)


def test_prefix_trie_of_one_long_conversation_over_many_ranges(spark):
    """A conversation that spans ranges and depth blocks, copies of it, and a head longer than its giver."""
    from skylattice.llm import trie

    rows = [(0, t, "u", f"{t % 7}") for t in range(9000)] + [(c, t, "u", f"{t % 7}") for c in (101, 102, 103) for t in range(4200)] + [(c, 0, "u", "only") for c in range(300, 340)]
    got = trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(8), heads=trie.borrowed_heads)
    built = trie_rows(got)
    heads = {c: crc_heads(c) for c in (0, 101, 102, 103, *range(300, 340))}
    assert {r[1] for r in built if r[0] == 0} >= {0, 8999}
    assert len(built) == len(trie_key_count(rows, heads))
    top = next(r for r in built if r[1] == 0)
    assert top[3] == 44 and top[5] == sum(r[4] == 0 for r in built)
    assert top[6] == sum((r[3] - 1) * size for r, size in zip(sorted(built), trie_key_count(rows, heads), strict=True))


def trie_key_count(rows, heads):
    """The size of the last text of each node, nodes in the order of (smallest member, depth)."""
    plain = defaultdict(list)
    for c, _, r, x in rows:
        plain[c].append((r, x))
    ids, nodes = {}, {}
    for c in sorted(plain):
        giver, h = heads[c]
        at, own = 0, plain.get(giver, [])[:h] + plain[c][h:]
        nodes.setdefault(0, (c, 0, 0))
        for d, turn in enumerate(own, 1):
            at = ids.setdefault((at, turn), len(ids) + 1)
            nodes.setdefault(at, (c, d, len(turn[1])))
    return [size for _, _, size in sorted(nodes.values())]


def test_prefix_trie_of_nothing(spark):
    from skylattice.llm import trie

    assert trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    only = trie.prefix_trie(spark.createDataFrame([(130, 0, "a", "x")], CONV), heads=lambda c: (c - c % 100, F.lit(5))).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(130, 0, 1, 1, hashlib.sha256(b"130").hexdigest())]


def test_scan_is_the_polynomial():
    from skylattice.llm import trie

    rng = np.random.default_rng(3)
    value, first = rng.integers(0, trie.PRIME, 500).astype(np.uint64), rng.random(500) < 0.05
    got, h = trie.scan(value, first, trie.BASE), 0
    for k in range(500):
        h = ((0 if first[k] else h) * trie.BASE + int(value[k])) % trie.PRIME
        assert h == int(got[k])


PAGE = "page_id long, url string, html string, payload string, kind string"


def archived(spark, rows, tmp_path, **options):
    from skylattice.llm import warc

    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([(*r, "p", "k") for r in rows], PAGE), path, **options)
    return path, warc.read_archives(spark, path)


def test_archives_give_back_every_page(spark, tmp_path):
    from skylattice.llm import warc

    rows = [(i, f"http://h{i % 3}.org/a b?{i}\r\nX: y", f"<p>page {i % 40} é</p>" * (1 + i % 5)) for i in range(120)]
    rows += [(500, None, None), (501, "", ""), (502, "u", "x" * 3_000_000), (None, "u", "only one"), (None, "v", "<p>page 1 é</p>" * 2), (7, "z", rows[7][2]), (7, "z", rows[7][2])]
    path, got = archived(spark, rows, tmp_path, archive_bytes=1 << 12)
    got = got.collect()
    assert not [r for r in got if r.problem] and len(got) == len(rows)
    assert len({r.archive for r in got}) > 3
    payload = [r[2] or "" for r in rows]
    least = {}
    for (i, _, _), h in zip(rows, payload, strict=True):
        if i is not None:
            least[h] = min(i, least.get(h, i))
    want = Counter()
    for h in set(payload):
        ids = [r[0] for r, own in zip(rows, payload, strict=True) if own == h]
        best = least.get(h)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            want[i, "response" if k == 0 else "revisit", len(h.encode()), warc.digest32(h.encode()), None if k == 0 else best] += 1
    page = lambda x: None if x in (None, "<urn:page:>") else int(x[10:-1])
    assert Counter((page(r.record_id), r.record_type, r.payload_bytes, r.payload_digest, page(r.refers_to)) for r in got) == want
    assert all(bytes(r.payload).decode() in payload for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert all("\r" not in (r.url or "") and "X: y" not in (r.url or "") for r in got)


def test_archives_of_few_bytes_and_of_nothing(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = archived(spark, rows, tmp_path / "a", min_bytes=3)[1].collect()
    assert sorted((r.record_id, r.record_type) for r in got) == [("<urn:page:1>", "response"), ("<urn:page:2>", "response"), ("<urn:page:3>", "response"), ("<urn:page:4>", "revisit")]
    assert archived(spark, [], tmp_path / "b")[1].collect() == []


def test_archives_are_held_against_their_headers():
    """Lengths, digests, headers and frames that are wrong are each found; the rest of the archive is read."""
    import struct

    import zstandard

    from skylattice.llm import warc

    good = warc.record("response", 1, "http://a", b"<p>hello</p>" * 50, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)["payload"] == b"<p>hello</p>" * 50
    dictionary = zstandard.train_dictionary(2000, [warc.record("response", k, "http://a", f"{k} some text to learn from {k * k}".encode() * 9, "2024") for k in range(300)]).as_bytes()
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    empty = warc.EMPTY_FRAME.encode()
    for lead in (warc.dictionary_frame(dictionary), warc.DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary):
        archive = lead + empty + encoder.compress(good) + empty + empty + encoder.compress(good + b"") + empty
        assert [x for _, x in warc.frames(archive)] == [good, good]
        with pytest.raises(ValueError, match="cut off"):
            list(warc.frames(archive[: -len(empty) - 3]))
    with pytest.raises(zstandard.ZstdError):
        list(warc.frames(encoder.compress(good)))  # no dictionary
    wrong = {
        "no WARC record": good.replace(b"WARC/1.1", b"WARC/9.1"),
        "announced": good.replace(b"</p>\r\n\r\n", b"</p>x\r\n\r\n"),
        "headers missing": good.replace(b"WARC-Date", b"WARC-Dote"),
        "no length of the block": re.sub(rb"(response\r\n)Content-Length: \d+", rb"\1Content-Length: -4", good),
        "block's digest": good.replace(b"hello", b"hullo"),
        "no header line": good.replace(b"WARC-Date: ", b"WARC-Date "),
        "two headers": good.replace(b"WARC-Date: ", b"WARC-Type: x\r\nWARC-Date: "),
    }
    for why, raw in wrong.items():
        with pytest.raises(ValueError, match=why):
            warc.parsed(raw)


def test_an_archive_that_is_cut_off_keeps_what_is_before(spark, tmp_path):
    from skylattice.llm import warc

    path, got = archived(spark, [(i, "u", f"text {i} " * 30) for i in range(20)], tmp_path)
    whole = Counter(r.archive.rpartition("/")[2] for r in got.collect())
    file = tmp_path / "archives" / max(whole, key=whole.get)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "one").write_bytes(file.read_bytes()[:-40])
    rows = warc.read_archives(spark, str(tmp_path / "bad")).collect()
    assert sum(r.problem is None for r in rows) == whole[file.name] - 1 and sum("cut off" in (r.problem or "") for r in rows) == 1


def phrases_of(docs, least, longest, top, percent=100):
    """The contract's rules on lists of words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for d in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least}
        inside = lambda s, b: any(b[i : i + len(s)] == s for i in range(len(b) - len(s) + 1))
        rows = []
        for p, a in often.items():
            if len(p) < 2 or any(len(b) > len(p) and 100 * x >= percent * a and inside(p, b) for b, x in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("percent", "words", "bits"), [(100, 1 << 21, 27), (70, 60, 12)])
def test_phrases_by_brute_force(spark, percent, words, bits):
    from skylattice.llm import phrases

    rng = random.Random(percent)
    vocabulary = ["the", "The", "of", "a", "New", "york", "city", "é", "É", "in", "\x1c", "x" * 40]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    docs += [("en", "new york city hall " * 20), ("en", None), ("en", ""), ("xx", "..."), ("en", "new york city hall " * 20)]
    df = spark.createDataFrame([(i, t, g, "s", 0, 0.0, 0) for i, (g, t) in enumerate(docs)], DOC).repartition(5)
    got = phrases.collocations(df, least=8, top=40, percent=percent, shard_words=words, filter_bits=bits).collect()
    assert sorted(map(tuple, got)) == phrases_of(docs, 8, 5, 40, percent)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_phrases_of_long_texts_and_large_numbers(spark, monkeypatch):
    """A text beyond a block is cut at piece ends alone, and products over 64 bits keep exact."""
    from skylattice.llm import phrases

    text = ("one two three. " * 5000 + "one " * 200)[:-1]
    assert b"".join(phrases.blocks(text.encode(), 1000)) == text.encode() and all(b.startswith((b"one", b".")) for b in phrases.blocks(text.encode(), 1000))
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, *_, **__: docs)
    n, a, left, right = 4 * 10**14, 3 * 10**14 + 1, 3 * 10**14 + 7, 10**14 * 3 + 13
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "p", left), ("en", 1, "q", right), ("en", 2, "p q", a)], "lang string, words int, phrase string, f long")
    assert [r.score for r in phrases.collocations(counts).collect()] == [1000 * a * n // (left * right)]


def test_automaton_states_are_endpos_classes():
    from skylattice.llm import phrases

    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 40, 90):
        ids = rng.integers(0, 4, n).astype(np.int32)
        pair = np.r_[[False] * (n > 0), rng.random(max(n - 1, 0)) < 0.9]
        run = phrases.runs(ids, np.array([False, True, True, True]), pair & np.r_[[False] * (n > 0), ids[:-1] > 0], 5) if n else np.zeros(0, int)
        found, places = phrases.automaton(ids, run, 5), defaultdict(set)
        for i in range(n):
            for d in range(1, run[i] + 1):
                places[tuple(ids[i - d + 1 : i + 1])].add(i)
        word = lambda s, d: tuple(ids[found.end[s] - d + 1 : found.end[s] + 1])
        classes = defaultdict(list)
        for w, at in places.items():
            classes[frozenset(at)].append(len(w))
        assert len(classes) == len(found.end)
        for s in range(len(found.end)):
            at = places[word(s, found.longest[s])]
            assert found.count[s] == len(at) and sorted(classes[frozenset(at)]) == list(range(found.shortest[s], found.longest[s] + 1))
            up = found.link[s]
            assert (found.shortest[s] == 1) if up < 0 else (found.longest[up] == found.shortest[s] - 1 and places[word(up, found.longest[up])] == places[word(s, found.shortest[s] - 1)])


# Names that clash, ids that are no numbers, white space without end


def test_result_names_that_the_id_has(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", None]
    rows = lambda name: spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], f"{name} long, text string, source string")
    assert simhash.near_duplicates(rows("Fingerprint"), "Fingerprint").columns == ["Fingerprint", "_fingerprint", "component_id"]
    assert {r["_fingerprint"] for r in simhash.near_duplicates(rows("fingerprint"), "fingerprint").collect()} == {f"{simhash.fingerprint((t or '').encode()):016x}" for t in texts}
    mixed = mixing.mix(rows("place"), "place")
    assert mixed.columns == ["place", "source", "n_tokens", "weight", "epoch", "block", "_place"] and {r.place for r in mixed.collect()} == {0, 1, 2}
    items = spark.createDataFrame([(7, texts[0])], "item_id long, text string")
    found = decontaminate.contaminated(rows("item_id"), items, "item_id")
    assert {(r.item_id, r._item_id) for r in found.collect()} == {(0, 7), (1, 7)}


def test_conversations_whose_ids_are_no_numbers_are_set_apart(spark):
    rows = [("c-1", "0", '{"role": "user", "text": "a"}'), ("12", "0", '{"role": "user", "text": "b"}'), ("12", "x", '{"role": "user", "text": "c"}'), (None, "0", '{"role": "user", "text": "d"}')]
    turns = chat.turns_of(spark.createDataFrame(rows, "conv_id string, turn string, record string"), "conv_id", "turn", "record").cache()
    assert sorted(r.problem for r in chat.set_apart(turns).collect()) == ["no whole number in conv_id: c-1", "no whole number in turn: x"]
    assert sorted((r.conv_id is None, r.conv_id, r.n_turns) for r in chat.digests(chat.format_turns(turns)).collect()) == [(False, 12, 1), (True, None, 1)]


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "\u3000", " \x85\xa0"])
@pytest.mark.parametrize(("before", "after"), [("word", " next"), ("", ""), ("a.", "5x"), ("it's\x1c", "\x1cq"), ("end", "")])
def test_runs_of_white_space_are_encoded_as_the_pattern_has_them(blank, before, after):
    """Shorter runs, which the pattern itself can take, show that cutting leaves the tokens alone."""
    enc, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for many in (4096, 5001):
        text = before + blank * many + after
        assert tokens.encoded(enc, text).tolist() == enc.encode_ordinary(text)
    text = before + blank * 5000 + after + blank * 4500 + "z" + blank * 3
    assert tokens.encoded(enc, text).tolist() == enc.encode_ordinary(text)


def test_two_million_blanks(spark):
    texts = ["a " + " " * 2_000_000 + "b\nc", "\n" * 2_000_000, "x" + "\t\n " * 700_000 + "y"]
    rows = tokens.section_tokens(docs_of(spark, texts)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end_char").alias("end")).collect()
    enc, size = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for r in rows:
        ids = tokens.encoded(enc, texts[r.doc_id])
        assert r.n == len(ids) and r.end == len(texts[r.doc_id]) and size[ids].sum() == len(texts[r.doc_id].encode())


def test_released_models_are_sent_again(spark):
    docs = docs_of(spark, ["some words here", "and more of them"])
    scored = toxicity.score(docs, ({"words": 1.0}, -1.0))
    first = sorted(r.score for r in scored.collect())
    common.release()
    assert sorted(r.score for r in scored.collect()) == first

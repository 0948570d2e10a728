"""Operators that learn or choose: accuracy on held-out rows, invariants, and the awkward cases."""

import hashlib
import random
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bitempo.llm import imatch, langid, mixing, quality, toxicity
from bitempo.llm.components import components

from .helpers import corpus, frame, space_words, words

# ---- mixing


def test_targets():
    sizes = {None: 100, "b": 10, "a": 1000}
    got = mixing.mix_targets(sizes)
    # a, b, null weigh 5, 2, 1; b stops at 20, the rest is shared 5 to 1.
    assert got["b"] == 20 and got[None] == 200 and got["a"] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.mix_targets({}) == {} and mixing.mix_targets({"a": 0}) == {"a": 0.0}


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        patterns = [(sorted(rng.sample(range(3), rng.randrange(1, 4))), rng.randrange(0, 4)) for _ in range(3)]
        quotas = [rng.randrange(0, 5) for _ in range(3)]
        taken, credit = mixing.min_cost_flow(patterns, quotas)
        for p, t in enumerate(taken):
            assert t == sum(n for (q, _), n in credit.items() if q == p) and t <= 2 * patterns[p][1]
        best = None
        for amounts in product(*(range(2 * size + 1) for _, size in patterns)):
            # Hall's condition for sending these amounts into the quotas.
            sets = product(*([0, 1] for _ in patterns))
            if all(sum(a for a, on in zip(amounts, s) if on)
                   <= sum(quotas[k] for k in {k for (own, _), on in zip(patterns, s) if on for k in own}) for s in sets):
                cost = sum(max(0, a - size) for a, (_, size) in zip(amounts, patterns))
                best = max(best, (sum(amounts), -cost)) if best else (sum(amounts), -cost)
        cost = sum(max(0, t - size) for t, (_, size) in zip(taken, patterns))
        assert (sum(taken), -cost) == best


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 60)), None, rng.choice(["a", "b", None, "z"]), 0, "n", i, "v") for i in range(600)]
    rows += corpus(unique=False)
    docs = frame(spark, rows)
    sized = docs.select("doc_id", F.array("source").alias("s"), mixing.text_size(F.col("text")).alias("n"))
    one, two = (mixing.mix(sized, "doc_id", "s", "n") for _ in range(2))
    units = one.units.collect()
    assert sorted(map(repr, units)) == sorted(map(repr, two.units.collect()))
    assert sum(u.rows for u in units) == len(rows) and all(0 <= u.copies <= 2 for u in units)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(space_words(r[1]))
    want = mixing.mix_targets(sizes)
    for s in one.sources.collect():
        took = sum(u.copies * u["size"] * u.rows for u in units if u.sources == [s.source])
        assert s.source_size == sizes[s.source] and s.target == pytest.approx(want[s.source])
        # Whole documents: nearer than half of the longest one.
        longest = max((u["size"] for u in units if u.sources == [s.source]), default=0)
        assert abs(took - s.target) <= max(0.02 * s.target + 3, longest / 2)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(u.copies * u.rows for u in units)


def many_sources(spark, shared):
    """Forty sources, one of them null and one with a third of all words; ``shared`` adds documents of two or three."""
    names = [None, *(f"site{i:02d}" for i in range(39))]
    rows = [(i, [names[i % 40]], 1 + i * 7 % 23) for i in range(600)]
    rows += [(1000 + i, ["site05"], 9) for i in range(300)]
    if shared:
        rows += [(2000 + i, ["site01", "site02"], 5 + i % 3) for i in range(40)]
        rows += [(3000 + i, [None, "site02", "site03"], 4) for i in range(30)] + [(4000, [], 8), (4001, None, 8)]
    return spark.createDataFrame(rows, "doc_id long, s array<string>, n long")


@pytest.mark.parametrize("shared, most", [(False, 39), (True, 12)])
def test_many_source_sets_mix_as_on_the_driver(spark, shared, most):
    docs = many_sources(spark, shared)
    plain = mixing.mix(docs, "doc_id", "s", "n")
    wide = mixing.mix(docs, "doc_id", "s", "n", most_patterns=most)

    def rows(df):
        return sorted(map(repr, df.collect()))

    assert rows(wide.sources) == rows(plain.sources)
    assert rows(wide.units.orderBy("id")) == rows(plain.units.orderBy("id"))


def test_only_shared_source_sets_are_limited(spark):
    with pytest.raises(ValueError):
        mixing.mix(many_sources(spark, True), "doc_id", "s", "n", most_patterns=4)


@pytest.mark.parametrize("sizes", [[5], [0, 0], [1, 900, 1, 1, 50], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 900]])
def test_targets_in_spark_equal_those_on_the_driver(spark, sizes):
    totals = {f"s{i:02d}": n for i, n in enumerate(sizes)} | {None: 7}
    got = mixing.spark_targets(spark.createDataFrame(list(totals.items()), "source string, n long"))
    assert {r.source: r.target for r in got.collect()} == mixing.mix_targets(totals)


def test_mix_of_overlapping_sources_and_of_nothing(spark):
    rows = [(i, ["a"] if i % 2 else ["b", "a", "a"], 10) for i in range(100)] + [(200, None, 5), (201, [], 5), (202, [None], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, n long")
    units = mixing.mix(docs, "doc_id", "s", "n").units.collect()
    assert all(u.copies == 0 for u in units if not u.sources)
    assert sum(u.copies for u in units if u.sources == ["a"]) > 0
    assert mixing.mix(docs.limit(0), "doc_id", "s", "n").units.count() == 0
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


# ---- language


def languages(seed, n):
    rng = random.Random(seed)
    parts = {"xx": ["the", "ing", "tion", "er"], "yy": ["sch", "ung", "ein", "keit"], "zz": ["eau", "oux", "ais", "ère"]}
    make = lambda name, k: " ".join("".join(rng.choices(parts[name], k=rng.randrange(1, 4))) for _ in range(k))
    rows = []
    for i in range(n):
        name = rng.choice(list(parts))
        rows.append((i, make(name, rng.randrange(3, 60)), name))
    return rows, make


def test_language(spark):
    rows, make = languages(1, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, make("xx", 200) + " " + make("yy", 200)), (1004, make("zz", 6000))]
    model = langid.learn(docs.filter("doc_id < 300").unionByName(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))))
    assert model.languages == ["xx", "yy", "zz"]
    test = docs.filter("doc_id >= 300").select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.p for r in test.select("doc_id", langid.predict(F.col("text"), model, spark).alias("p")).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([got[i].lang_pred == truth[i] for i in range(300, 400)]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert sorted(got[1003].languages) == ["xx", "yy"] and 0.4 < got[1003].score < 0.6
    assert got[1004].lang_pred == "zz"
    empty = langid.learn(docs.limit(0))
    assert {r.p.lang_pred for r in test.select(langid.predict(F.col("text"), empty, spark).alias("p")).collect()} == {"und"}


def test_language_sets_of_any_size(spark):
    rng = random.Random(2)
    make = lambda k, n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwx"[4 * k : 4 * k + 4], k=6)) for _ in range(n))
    names = [f"l{k}" for k in range(6)]
    rows = [(i, make(i % 6, 60), names[i % 6]) for i in range(120)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(n, " ".join(make(k, 40) for k in range(n))) for n in range(1, 7)]
    docs = spark.createDataFrame(tests, "n int, text string")
    for r in docs.select("n", langid.predict(F.col("text"), model, spark).alias("p")).collect():
        assert r.p.languages == names[: r.n] and r.p.score == pytest.approx(1 / r.n, abs=0.02)


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["grumblefax", "snortlewick", "vexomatic"]
    def make(toxic):
        own = words(rng, rng.randrange(5, 120)).split()
        if toxic:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        return " ".join(own)
    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    learning = spark.createDataFrame(rows + [(900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    texts, labels = learning.select("doc_id", "text"), learning.select("doc_id", "toxic")
    model = toxicity.learn(texts, labels)
    tests = [(i, make(i % 2 == 0), i % 2 == 0) for i in range(80)]
    tests += [(200, "w1 w2 grumblefaxx w3 w9", True), (201, "SNORTLEWICKS! w5 w6 w7", True), (202, None, False), (203, "", False),
              (204, words(rng, 5000), False), (205, words(rng, 5000) + " vexomatic vexomatics", True)]
    frame_ = spark.createDataFrame([t[:2] for t in tests], "doc_id long, text string")
    got = {r.doc_id: r.s for r in frame_.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[202] == got[203] == 0.0
    assert [i for i, _, y in tests if (got[i] >= 0.5) != y] == []
    assert toxicity.learn(texts, labels.filter("toxic = 0")).empty
    assert toxicity.learn(texts.limit(0), labels).empty


def labelled(rng, n):
    """Rows of id, text and label, one in three with a bad word."""
    return [(i, " ".join(words(rng, 20).split() + ["grumblefax"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(n)]


def first_in_order(make, rows):
    """The first of the texts ``make(i)`` whose hash comes before those of all rows."""
    order = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63
    least = min(order(t) for _, t, _ in rows)
    return next(t for t in map(make, range(100_000)) if order(t) < least)


def test_toxicity_draws_on_after_a_long_text(spark):
    rng = random.Random(11)
    rows = labelled(rng, 90)
    filler = words(rng, 300) + " "
    filler = filler * (9 * (1 << 20) // len(filler) + 1)
    long = first_in_order(lambda i: f"long{i} grumblefax {filler}", rows)
    assert len(long) > 9 << 20
    docs = spark.createDataFrame(rows + [(900, long, 1)], "doc_id long, text string, toxic int").repartition(4)
    texts, y = toxicity.training_sample(docs, docs, "doc_id", "text", "toxic", toxicity.TRAIN_ROWS, toxicity.TRAIN_BYTES)
    assert sum(y == 1) == 31 and sum(y == 0) == 60
    assert sum(len(t) for t, label in zip(texts, y) if label == 1) <= toxicity.TRAIN_BYTES // 2
    assert max(map(len, texts)) > toxicity.TRAIN_BYTES // 2 - 10_000
    assert {t for _, t, _ in rows} <= {t.decode() for t in texts}
    assert not toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), size=1 << 16).empty


def test_toxicity_draws_copies_once(spark):
    rng = random.Random(12)
    rows = labelled(rng, 90)
    copied = first_in_order(lambda i: f"copy{i} grumblefax w1 w2", rows)
    rows += [(1000 + i, copied, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, y = toxicity.training_sample(docs, docs, "doc_id", "text", "toxic", 40, toxicity.TRAIN_BYTES)
    assert sum(y == 1) == 31 and sum(y == 0) == 40 and len(set(texts)) == 71


def test_longest_part():
    for lengths, size in (([], 9), ([3, 3], 9), ([1, 100, 100], 21), ([5, 5, 5], 7), ([9 << 20, 10, 20], 8 << 20)):
        part = toxicity.longest_part(lengths, size)
        used = lambda p: sum(min(n, p) for n in lengths)
        assert used(part) <= size and (part == max(lengths, default=0) or used(part + 1) > size)


def test_worst_stretch_is_the_best_of_all():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 3, 4, 5, 40])
    values = rng.normal(size=sizes.sum())
    top, first, length = toxicity.worst_stretch(values, sizes)
    for d, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        k = min(n, toxicity.STRETCH)
        means = [values[a + i : a + i + k].mean() for i in range(n - k + 1)]
        assert top[d] == pytest.approx(max(means)) and length[d] == k and first[d] == a + int(np.argmax(means))


# ---- quality


def test_cells_of_a_full_batch_need_little_memory():
    """the numbers of a batch of 8 MB once took hundreds of MB in every Python worker."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}." for i in rng.integers(0, 30_000, 500)).encode() for _ in range(2_500)]
    batch = pa.array([None, *texts, b""], pa.binary())
    tracemalloc.start()
    n = np.zeros(len(batch), np.int64)
    for part, cells, doc in quality.ngram_cells(batch):
        assert cells.min() >= 0 and cells.max() < quality.CELLS
        n[part] += np.bincount(doc, minlength=part.stop - part.start)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [0, *[1999] * 2_500, 0]
    assert peak < 100 << 20


def test_cells_are_those_of_tokens_cut_by_a_regular_expression(monkeypatch):
    import re

    import pyarrow as pa
    import xxhash

    monkeypatch.setattr(quality, "PART_BYTES", 50)
    rng = np.random.default_rng(6)
    signs = list("abZ09 \n\t\x0b\x0c\r\x1c.*-'é漢\x00\x7f{[@`")
    texts = [None, b"", b" ", b"a a a", *("".join(rng.choice(signs, rng.integers(30))).encode() for _ in range(300))]
    got = {}
    for part, cells, doc in quality.ngram_cells(pa.array(texts, pa.binary())):
        for i in range(part.stop - part.start):
            got[part.start + i] = cells[doc == i].tolist()
    for i, raw in enumerate(texts):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", raw or b"")
        h = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
        same = np.array([a == b for a, b in zip(tokens, tokens[1:])], bool)
        pair = np.where(same, quality.AGAIN, quality.mix(quality.mix(h[:-1]) + h[1:]))
        assert got[i] == (np.concatenate((quality.mix(h), pair)) % np.uint64(quality.CELLS)).tolist()


def test_quality(spark):
    rng = random.Random(7)
    junk = lambda: " ".join(f"{w}###" for w in words(rng, rng.randrange(10, 80)).split())
    stuck = lambda: "again " * rng.randrange(20, 90)
    rows = [(i, rng.choice([junk, stuck])() if i % 5 == 0 else words(rng, rng.randrange(8, 90))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "w1"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(250)] + [(1, None), (7777, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.resample(docs, model).collect()
    kept = {r.doc_id for r in got if r.kept}
    clean = {i for i in range(500) if i % 5}
    assert len(got) == len(rows) and len(clean & kept) >= 0.97 * len(clean) and len(kept - clean) <= 5
    assert {r.doc_id for r in quality.good_documents(docs, labels).collect()} == kept
    fixed = quality.resample(docs, model, k=50)
    keys = sorted((r.sample_key for r in fixed.collect()), reverse=True)
    assert sum(r.kept for r in fixed.collect()) == sum(k >= keys[49] for k in keys)
    for k in (0, 10_000):
        assert fixed.count() == len(rows) and sum(r.kept for r in quality.resample(docs, model, k=k).collect()) == (k and len(rows))
    assert quality.good_documents(docs.limit(0), labels).count() == 0
    assert quality.good_documents(docs, labels.limit(0)).count() == len(rows)


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXACT_KEYS", 5)
    monkeypatch.setattr(quality, "BINS", 7)
    values = [float(x) for x in np.random.default_rng(2).normal(size=200)] + [0.5] * 30 + [-1e9, 1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 57, 80, 120, 232):
        want = float("-inf") if k >= len(values) else sorted(values, reverse=True)[k - 1]
        assert quality.kth_largest(keys, k) == want


# ---- fingerprints


@pytest.mark.parametrize("unique", [True, False])
def test_fingerprints(spark, unique):
    rows = corpus(unique=unique)
    got = imatch.fingerprint_edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    if unique:
        order = sorted(rows, key=lambda r: r[0])
        by_id = {r.doc_id: r for r in got}
        for k, r in enumerate(order):
            text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
            q = len(text) // 4
            edited = text[: len(text) - q] + after[:q]
            g = by_id[r[0]]
            assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
            assert (g.near_edited == 1.0) == (g.fingerprint == g.edited_fingerprint)
        prints = {}
        for r in rows:
            prints.setdefault(r[1] or "", set()).add(by_id[r[0]].fingerprint)
        assert all(len(p) == 1 for p in prints.values())
    one = imatch.fingerprint_edits(frame(spark, rows[10:11])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.fingerprint_edits(frame(spark, [])).count() == 0


def test_fingerprints_tell_edits_from_strangers(spark):
    rng = random.Random(8)
    topics = [[f"t{t}x{i}" for i in range(300)] for t in range(60)]
    rows = [(i, " ".join(rng.choices(topics[i % 60], k=rng.randrange(60, 300))), None, None, 0, "n", i, "v") for i in range(600)]
    got = imatch.fingerprint_edits(frame(spark, rows)).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert np.mean([r.near_edited for r in got]) > 0.3 > np.mean([r.near_next for r in got])


def test_fingerprints_of_a_text_that_a_third_of_the_rows_hold(spark):
    rng = random.Random(10)
    topics = [[f"t{t}x{i}" for i in range(300)] for t in range(60)]
    texts = [" ".join(rng.choices(topics[i % 60], k=rng.randrange(60, 300))) for i in range(600)]
    texts += [texts[7]] * 299
    rng.shuffle(texts)
    copied = max(texts, key=texts.count)
    rows = [(i, t, None, None, 0, "n", i, "v") for i, t in enumerate(texts)]
    got = imatch.fingerprint_edits(frame(spark, rows)).collect()
    after = {i: texts[(i + 1) % len(texts)] for i in range(len(texts))}
    copies = [r for r in got if texts[r.doc_id] == copied and after[r.doc_id] != copied]
    assert len(copies) > 150 and np.mean([r.near_edited > r.near_next for r in copies]) > 0.95
    # One text: how many of its subsets survive an edit varies from text to text.
    assert np.mean([r.near_edited for r in copies]) > 0.2 > 10 * np.mean([r.near_next for r in copies])


# ---- components and the pipeline


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "mixing", "token_file"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.exceptAll(before).count() == 0
        else:
            assert docs.distinct().exceptAll(before.distinct()).count() == 0
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] <= sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == sizes[4]

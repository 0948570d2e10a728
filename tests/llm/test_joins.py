"""Ranked search, Jaccard join and manifest against brute force, with the awkward cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitempo.llm import lexical, manifest, minhash, sigtree

from .helpers import alnum_words, corpus, frame, lower, space_words, words

# ---- ranked search


def ranked(rows, items, top=10):
    docs = [(r[0], Counter(alnum_words(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in docs:
            m = 25 + 75 * n * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in alnum_words(text) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc, score))
        out += [(item, k + 1, s[3], s[4]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("unique,item_bytes", [(True, 1 << 19), (False, 400)])
def test_ranked_search(spark, unique, item_bytes):
    rows = corpus(unique=unique)
    items = [(1, "w3 w5 W7 w9 s1"), (2, "漢字 ünï"), (3, "unknownterm"), (4, None), (5, ""), (6, "x x x w1 X"),
             (7, words(random.Random(3), 200)), (8, rows[5][1]), (8, "extra"), (None, "the id id no")]
    got = lexical.search(lexical.build_index(frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string"),
                         item_bytes=item_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(lexical.build_index(frame(spark, [])), items).count() == 0
    assert lexical.search(lexical.build_index(frame(spark)), items.limit(0)).count() == 0


def test_bounds_hold_and_exclude():
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(5, 200)).encode() for _ in range(300)]
    described = [lexical.describe(t) for t in texts]
    width = lexical.BITS_PER_KEY * max(len(d.keys) for d in described)
    as_bytes = lambda x: np.array(x, np.int64).tobytes()
    block = {"places": as_bytes(range(300)), "ids": as_bytes(range(300)), "terms": as_bytes([d.terms for d in described]),
             "most": as_bytes([d.most for d in described]), "width": width, "slices": lexical.sliced(described, width)}
    index = lexical.Index(None, None, 300, sum(d.terms for d in described))
    parsed, terms = lexical.parse_items([(i, words(rng, 8).encode()) for i in range(20)])
    df = {i: sum(t in x.split() for x in texts) for t, i in terms.items()}
    q = lexical.as_queries(parsed, terms, df, index)
    _, _, bounds = lexical.upper_bounds(block, q)
    names = dict(parsed)
    close = 0
    for row, no in zip(bounds, q.names):
        for d, text in enumerate(texts):
            counts = Counter(text.split())
            norm = int(q.norm(np.array([described[d].terms]))[0])
            score = sum(n * lexical.weight(df[terms[t]], 300) * (10**9 * counts[t] // (1000 * counts[t] + 8 * norm))
                        for t, n in names[no].items() if counts[t])
            assert row[d] >= score
            close += row[d] <= 1.2 * score + 1
    assert close > 0.8 * bounds.size


# ---- Jaccard join


def shingle_set(text):
    own = space_words(lower(text))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def joined(rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)], key=repr)


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def families(seed, groups, size):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = words(rng, rng.randrange(20, 300), f"g{g}_")
        rows += [edited(rng, base, rng.random() * 0.06) for _ in range(size)]
    rng.shuffle(rows)
    return [(i * 2, t, None, None, None, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("unique", [True, False])
def test_jaccard_join(spark, unique):
    rows = corpus(unique=unique)
    assert sorted(map(tuple, sigtree.jaccard_components(frame(spark, rows)).collect()), key=repr) == joined(rows, 80)


@pytest.mark.parametrize("block", [2048, 7])
def test_jaccard_join_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    rows = families(2, 4, 60)
    want = joined(rows, 80)
    assert len({w[2] for w in want}) > 8
    assert sorted(map(tuple, sigtree.jaccard_components(frame(spark, rows)).collect()), key=repr) == want


@pytest.mark.parametrize("width", [1 << 14, 64])
def test_tree_links_join_what_brute_force_joins(monkeypatch, width):
    monkeypatch.setattr(sigtree, "WIDTH", width)
    rng = np.random.default_rng(4)
    sets = []
    for g in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(1, 120)).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < rng.random() * 0.2, rng.integers(0, 1 << 62, len(base)).astype(np.uint64), base))
                 for _ in range(20)]
    links = sigtree.tree_links(sets, np.arange(len(sets)), 80)
    assert len(links) < len(sets)
    label = np.arange(len(sets))
    for a, b in links:
        k = len(np.intersect1d(sets[a], sets[b]))
        assert 180 * k >= 80 * (len(sets[a]) + len(sets[b]))
        label[label == label[b]] = label[a]
    for a in range(len(sets)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 180 * k >= 80 * (len(sets[a]) + len(sets[b])):
                assert label[a] == label[b]


def test_jaccard_join_of_nothing(spark):
    assert sigtree.jaccard_components(frame(spark, [])).count() == 0


# ---- manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    tree = [digests]
    while len(tree[-1]) > 1:
        tree.append([sha(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    return tree


def plain_path(tree, i):
    path = []
    for level in tree[:-1]:
        run = i // 3 * 3
        path.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return path


def plain_manifest(rows, found):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {}
    for s in sources:
        own = [(r[0], plain_leaf(r, r[1]), plain_leaf(r, found(r))) for r in rows if r[3] == s]
        groups[s] = sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    trees = {s: plain_tree([x[1] for x in groups[s]]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc, leaf, other) in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            folded = other
            for before, after in path:
                folded = sha(*before, folded, *after)
            proof = sha(*(x for before, after in path for x in (*before, *after)))
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def judged(spark, rows):
    docs = frame(spark, rows)
    found = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return manifest.manifest(manifest.dataset_leaves(docs, FIELDS, text=found))


def changed(row):
    return row[1] + "!" if row[0] is not None and row[0] % 2 == 0 and row[1] is not None else row[1]


@pytest.mark.parametrize("step", [1, 2, 7])
def test_manifest(spark, monkeypatch, step):
    monkeypatch.setattr(manifest, "STEP", step)
    monkeypatch.setattr(manifest, "COPIES", 2)
    rows = corpus(unique=False) + [(5, "same id", "x", "b", 1, "", 0, "")] * 6 + [(5, None, "x", "b", 1, "", 0, "")]
    rows += [(10**12 + i * i * 977, f"far {i}", None, ("é", "b")[i % 2], i, "", 0, "") for i in range(40)]
    rows += [(None, None, None, None, None, None, None, None)] * 3
    assert sorted(map(tuple, judged(spark, rows).collect()), key=repr) == plain_manifest(rows, changed)


def test_manifest_of_one_and_of_nothing(spark):
    one = corpus()[9:10]
    assert list(map(tuple, judged(spark, one).collect())) == plain_manifest(one, changed)
    assert judged(spark, []).count() == 0



# ---- near-duplicates of large groups


@pytest.mark.parametrize("block", [2048, 9])
def test_near_duplicates_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    rows = families(7, 3, 60)
    got = minhash.near_duplicates(frame(spark, rows)).select("id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == joined(rows, 75)


def test_a_group_gives_fewer_links_than_it_has_classes():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    # Pairs lie on both sides of the threshold, so nearly all of them are candidates.
    sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 1 << 62, 60).astype(np.uint64), base)) for _ in range(1500)]
    links = minhash.near_links(sets, np.arange(len(sets)), 75)
    assert len(links) < len(sets)
    label = np.arange(len(sets))
    for a, b in links:
        label[label == label[b]] = label[a]
    some = rng.integers(0, len(sets), (4000, 2))
    for a, b in some:
        k = len(np.intersect1d(sets[a], sets[b]))
        if 175 * k >= 75 * (len(sets[a]) + len(sets[b])):
            assert label[a] == label[b]


def test_one_of_each_where_names_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "d e f", 6), (2, "a b c", 7)], "doc_id long, text string, near_digest_kept long")
    docs = docs.withColumn("near_id", F.lit(1)).withColumn("near_digest", F.lit(2))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.near_digest_kept for r in kept.collect()) == [5, 6]


def test_mixed_documents_where_names_clash(spark):
    from bitempo.llm import mixing

    docs = frame(spark).withColumn("u_copies", F.lit(7)).withColumn("u_id", F.lit("x")).withColumn("sources", F.lit(1))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() > 0
    assert {r.u_copies for r in got.select("u_copies").distinct().collect()} == {7}

"""Operators with one right answer, against brute force: token files, substrings, near-duplicates, windows, licenses."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from bitempo.llm import decontam, licenses, minhash, substring, token_files
from bitempo.llm.queries import tokenizer_definition
from bitempo.session import shared_dir

from .helpers import SCHEMA, alnum_words, corpus, frame, lower, space_words, words

# ---- token files


def test_pieces_give_the_ids_of_whole_texts():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] for r in corpus()] + [
        "  lead", "trail  ", "a  b\n\nc \n d", "tab\t x\ty", "it's don't I'll", "x\x1cy z", "a<|endoftext|>b c", " ", "\n\n",
        "\r\n a\r\n b", "é x 　 y",
    ]
    got = token_files.PieceEncoder(tokenizer_definition()).encode_all(texts)
    assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert token_files.PieceEncoder(tokenizer_definition()).encode_all([]) == []


def test_pieces_of_any_signs_give_the_ids_of_whole_texts():
    definition = tokenizer_definition()
    plain, rng = Tokenizer.from_str(definition), random.Random(4)
    signs = "aZtsrevmld'09.*&-_  \n\n\t\r\x0b\x0c\x00\x1c\x1f<|>éß×÷Šǅж漢한ñ\x85\xa0\u1680\u180e\u2003\u200b’\u2028\u3000\ufeff٠²Ⅰα🙂あ"
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(4000)]
    # Every character up to the end of the CJK signs, between others.
    texts += [
        rng.choice(["a", "1", "*", " ", "\n", "'"]) + chr(c) + rng.choice(["s", "1", "*", " a", "\na", " ", "'s"])
        for c in range(1, 0xA000)
    ]
    got = token_files.PieceEncoder(definition).encode_all(texts)
    assert [x.tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_words_and_signs_are_learned_once(monkeypatch):
    """a word is not tokenised anew with every sign after it, nor after pieces were forgotten."""
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    signs = [".", ",", "***", "&&&", "!"]
    encoder = token_files.PieceEncoder(tokenizer_definition())
    encoder.encode_all([" ".join(n + s for n in names for s in signs)])
    assert len(encoder.known) <= 401 + len(signs)
    learned, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda keys: (learned.extend(keys), learn(keys)))
    monkeypatch.setattr(token_files, "PIECES_KEPT", 100)
    before = encoder.encode_all([" x".join(names)])
    learned.clear()
    assert encoder.encode_all([" x".join(names)])[0].tolist() == before[0].tolist()
    assert not learned and len(encoder.known) <= 400


def test_a_tokenizer_with_another_pattern_gets_whole_texts():
    import json

    definition = json.loads(tokenizer_definition())
    definition["pre_tokenizer"]["add_prefix_space"] = True
    plain = Tokenizer.from_str(json.dumps(definition))
    texts = ["one two", "", "a, b\nc"]
    got = token_files.PieceEncoder(json.dumps(definition)).encode_all(texts)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [9, 12, 20])
def test_code_lengths(limit):
    rng = np.random.default_rng(limit)
    counts = np.where(rng.random(400) < 0.3, 0, (rng.pareto(0.5, 400) * 10).astype(np.int64) + 1)
    lengths = token_files.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[used] >= 1).all() and lengths.max() <= limit and not lengths[~used].any()
    assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    # Without a binding limit the code is as short as Huffman's.
    if limit == 20:
        import heapq

        heap, total = [int(c) for c in counts[used]], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert total == int((counts * lengths).sum())


@pytest.mark.parametrize("counts", [[0, 0], [0, 7], [3, 0, 3], [1] * 300])
def test_bits_round_trip(counts):
    counts = np.array(counts)
    rng = np.random.default_rng(3)
    ids = rng.permutation(np.repeat(np.arange(len(counts)), counts)) if counts.any() else np.zeros(0, np.int64)
    lengths = token_files.code_lengths(counts)
    bits, offsets = token_files.encode_bits(ids, token_files.canonical_codes(lengths)[1], lengths)
    assert token_files.Decoder(lengths).decode(bits, offsets, len(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("unique", [True, False])
def test_token_file(spark, unique):
    rows = corpus(unique=unique)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for r in order:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    _, got = token_files.token_file(frame(spark, rows), tokenizer_definition())
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_token_file_of_nothing_and_ids_themselves(spark):
    assert token_files.token_file(frame(spark, []), tokenizer_definition())[1].count() == 0
    path = shared_dir(spark, "tokens")
    token_files.write_tokens(frame(spark).limit(12), path, tokenizer_definition())
    for r in token_files.read_tokens(spark, path, digest=False).collect():
        assert len(r.ids) == 4 * r.n_tokens and np.frombuffer(r.ids, "<u4")[-1] == 2


# ---- substrings


def brute_repeats(rows, window):
    seen, out = {}, {}
    distinct = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=lambda x: (x[0], x[1]))
    for d in distinct:
        own = space_words(d[2])
        gone = set()
        for i in range(len(own) - window + 1):
            g = tuple(own[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.setdefault(g, d)
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[d] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((r[0], *out[r[0] is not None, r[0] or 0, r[1]]) for r in rows), key=repr)


@pytest.mark.parametrize("window,hot,shard", [(20, 10_000, 1 << 20), (6, 3, 200), (20, 1, 1)])
def test_substrings(spark, window, hot, shard):
    rng = random.Random(window)
    line = words(rng, 8, "line")
    rows = corpus()
    rows += [(1000 + i, f"{line} {words(rng, 30)} {line} {words(rng, 5)}", None, None, 0, "n", i, "v") for i in range(20)]
    rows += [(2000 + i, "y z " * (40 + i), None, None, 0, "n", i, "v") for i in range(6)]
    got = substring.remove_repeats(frame(spark, rows), window=window, gram=min(5, window), hot=hot, shard_words=shard)
    got = got.select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, window)


def test_substrings_of_repeated_ids_and_of_nothing(spark):
    rows = corpus(unique=False)
    got = substring.remove_repeats(frame(spark, rows)).select("id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute_repeats(rows, 20)
    assert len(got) == len(want) and sorted((r[0] or 0, r[1]) for r in got) == sorted((r[0] or 0, r[1]) for r in want)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_backward_search_finds_every_window():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 40))).encode() for _ in range(30)]
    for window in (2, 3, 5):
        masks = substring.repeats(texts, np.arange(30) // 3, (np.arange(30) % 3) * 100, window)
        seen = set()
        for t, m in zip(texts, masks):
            own = t.split()
            for i in range(len(own) - window + 1):
                g = tuple(own[i : i + window])
                assert bool(m[i]) == (g in seen)
                seen.add(g)


# ---- near-duplicates


def brute_components(rows):
    keys, sets = [], []
    for r in rows:
        own = space_words(lower(r[1]))
        n = min(5, len(own))
        keys.append(r[0])
        sets.append(frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i))) for i, k in enumerate(keys)), key=repr)


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = corpus()
    base = words(rng, 120).split()
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
        rows.append((500 + i, " ".join(own), None, None, 0, "n", i, "v"))
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    got = minhash.near_duplicates(frame(spark, rows)).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_near_duplicates_keep_one_of_each(spark):
    rows = corpus(unique=False)
    docs = frame(spark, rows)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute_components(rows) if r[1] == 0 or r[0] == r[2]}
    assert {r.doc_id for r in kept.collect()} == want
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_do_not_come_back_under_a_kept_id(spark):
    rng = random.Random(4)
    one, own, other = (words(rng, 100) for _ in range(3))
    rows = [(1, one), (5, own), (5, one + " more"), (None, other), (None, one + " yet"), (7, ""), (7, one + " seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, one), (5, own), (None, other), (7, "")], key=repr)


def test_signature_estimates_similarity():
    rng = random.Random(5)
    one = words(rng, 400).split()
    two = one[:340] + words(rng, 60, "z").split()
    a, b = (minhash.shingles(" ".join(x).encode()) for x in (one, two))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = minhash.packed_signatures(minhash.minima([a, b]))
    fields = lambda v: np.concatenate([(v >> np.uint64(s)) & np.uint64(15) for s in range(0, 64, 4)])
    agree = (fields(x) == fields(y)).mean()
    assert abs((agree - 1 / 16) / (15 / 16) - exact) < 0.2


# ---- decontamination


def brute_hits(rows, items, window=10):
    out = []
    for r in rows:
        own, hit, names = alnum_words(r[1]), set(), set()
        for name, text in items:
            test = alnum_words(text)
            k = min(window, len(test))
            for i in range(len(test) - k + 1 if k else 0):
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == test[i : i + k]:
                        hit.update(range(j, j + k))
                        names.add("" if name is None else str(name))
        out.append((r[0], len(own), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    rows = corpus(unique=False)
    parts = [r[1].split() for r in rows if r[1] and len(r[1].split()) > 25]
    items = [(i, " ".join(p[5:22])) for i, p in enumerate(parts[:6])] + [
        (10, parts[0][6] + "! " + parts[0][7]), (11, None), (12, "..."), (13, "never seen words at all"), (None, "one"),
        (14, " ".join(parts[1][5:22])), (2, "漢字"),
    ]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    judged = decontam.with_verdict(docs, tests, "v", block_bytes=block)
    got = [(r.doc_id, r.v.n_words, r.v.n_hit, r.v["items"]) for r in judged.collect()]
    assert sorted(got, key=repr) == brute_hits(rows, items)
    clean = decontam.decontaminate(docs, tests, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in got)


def test_decontamination_longest_match_and_empty_tables(spark):
    rng = random.Random(8)
    item = words(rng, 30)
    rows = [(1, f"a b {item} c", None, None, 0, "n", 1, "v"), (2, " ".join(item.split()[3:17]), None, None, 0, "n", 2, "v")]
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.v for r in decontam.with_verdict(frame(spark, rows), tests, "v").collect()}
    assert (got[1].longest, got[1].longest_at) == (30, 2) and (got[2].longest, got[2].longest_at) == (14, 0)
    none = decontam.with_verdict(frame(spark, rows), tests.limit(0), "v").collect()
    assert [r.v.n_hit for r in none] == [0, 0]
    assert decontam.decontaminate(frame(spark, []), tests).count() == 0


# ---- licenses


def test_licenses(spark):
    rng = random.Random(9)
    notice = licenses.NOTICES[0][1].split()
    edited = notice[:9] + ["so", "called"] + notice[9:]
    texts = [
        None, "", "MIT", "MIT License mit-license; the Apache\nLicense", "cc by cc by CC-BY", "gnu general public", words(rng, 50),
        f"{words(rng, 20)} GNU General Public License {words(rng, 5)}", f"{words(rng, 9)} {' '.join(edited)} {words(rng, 9)}",
        "Licensed under CC BY-NC 4.0.", "mit license " * 500,
    ]
    rows = [(i, t, None, None, 0, "n", i, "v") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "cc by", None, None, 0, "n", 1, "v"), (None, "mit license", None, None, 0, "n", 1, "v")]
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    base = {p: label for label, p in licenses.BASE}
    want = []
    for r in rows:
        own, starts, labels = alnum_words(r[1]), [], set()
        for phrase, label in base.items():
            q = phrase.split()
            hits = [i for i in range(len(own) - len(q) + 1) if own[i : i + len(q)] == q]
            starts += hits
            labels |= {label} if hits else set()
        want.append((r[0], len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    by_id = {r.id: r for r in got}
    assert by_id[8].labels == "apache" and 0.6 < by_id[8].score <= 1.0
    assert by_id[9].labels == "cc-by,cc-by-nc" and by_id[6].score == 0.0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses_of_an_evenly_broken_copy(spark):
    notice = dict((t, label) for label, t in licenses.NOTICES)
    text = next(t for t in notice if t.startswith("permission is hereby granted free"))
    own = text.split()
    broken = " ".join(w + " zq" * (i % 4 == 3) for i, w in enumerate(own))
    strays = " ".join(" ".join(own[i : i + 2]) + " zq zq zq zq zq" for i in range(0, len(own), 2))
    docs = spark.createDataFrame([(1, broken), (2, strays)], "doc_id long, text string")
    got = {r.id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit" and got[1].score == pytest.approx(15 / 19)
    assert got[2].labels == "" and got[2].score == 0.0

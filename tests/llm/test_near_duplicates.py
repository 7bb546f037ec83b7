"""Near-duplicate pairs, groups and cross-split overlaps against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebed.llm import near_duplicates, queries, signatures
from sluicebed.llm.components import component_labels
from sluicebed.llm.cross_split import cross_split_pairs, overlap_report
from sluicebed.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs, stacked_texts
from sluicebed.llm.words import likeness, word_bytes, words


def corpus(seed, n=150, length=40, vocabulary=400):
    """Texts over a small vocabulary, every third an edited, reordered copy of an earlier one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["the"] * 60 + ["of"] * 40
    texts = []
    for i in range(n):
        if i % 3 == 2:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            cut = rng.randrange(len(t))
            t = t[cut:] + t[:cut]
        else:
            t = [rng.choice(vocab) for _ in range(length)]
        texts.append(" ".join(t))
    return texts


def brute(rows, least=0.7, min_words=12):
    out = set()
    for (a, s), (b, t) in combinations(sorted({r for r in rows if r[0] is not None}), 2):
        x, y = words(s), words(t)
        if a != b and min(len(x), len(y)) >= min_words and likeness(x, y) >= least:
            out.add((a, b))
    return out


def check_recall(got, rows):
    """No false pair; all clear pairs; at least 97 % of all, the least alike ones included."""
    want = brute(rows)
    assert got <= want and brute(rows, 0.85) <= got and len(got) >= 0.97 * len(want)


DIRTY = [("n1", None), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"), ("e1", ""), ("s1", "too short"), ("s2", "too short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = [(f"d{i:04d}", t) for i, t in enumerate(corpus(seed))]
    rows += [("c1", rows[0][1].upper()), ("c2", rows[0][1] + "."), *DIRTY, rows[0], rows[5]]
    df = spark.createDataFrame(rows, "id string, text string").withColumns({"side": F.lit("x"), "cls": F.lit(1), "word": F.lit(None)}).repartition(3)
    texts = stacked_texts([(0, 0, df, "id", "text")])
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(texts, ["f"]).collect()}
    check_recall(got, rows)
    groups = near_duplicate_groups(texts, ["f"]).collect()
    assert {r.id for r in groups} == {x for p in got for x in p}
    assert len(groups) == len({r.id for r in groups})
    for a, b in got:
        assert len({r.group_id for r in groups if r.id in (a, b)}) == 1


def test_long_lists_lose_nothing(spark, monkeypatch):
    base = corpus(3, n=4)
    rng = random.Random(4)
    rows = [(f"o{i:04d}", t) for i, t in enumerate(corpus(9, n=500, vocabulary=3000))]
    for i in range(60):  # many versions of few texts make long posting lists
        t = base[i % 4].split()
        for _ in range(3):
            t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
        rows.append((f"d{i:03d}", " ".join(t)))
    texts = stacked_texts([(0, 0, spark.createDataFrame(rows, "id string, text string"), "id", "text")])
    whole = {(r.id_a, r.id_b) for r in near_duplicate_pairs(texts, ["f"]).collect()}
    check_recall(whole, rows)
    monkeypatch.setattr(signatures, "LONG_LIST", 3)
    assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(texts, ["f"]).collect()} == whole
    group = {r.id: r.group_id for r in near_duplicate_groups(texts, ["f"]).collect()}
    assert set(group) == {x for p in whole for x in p} and all(group[a] == group[b] for a, b in whole)


@pytest.mark.parametrize("n", [1001, 5000])
def test_every_pair_of_many_copies(spark, n):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(f"c{i:05d}", text if i % 2 else "P. " + text[:-2]) for i in range(n)] + [("z", "r s t u v w x y z aa bb cc dd")]
    pairs = near_duplicate_pairs(stacked_texts([(0, 0, spark.createDataFrame(rows, "id string, text string"), "id", "text")]), ["f"])
    got = pairs.agg(F.count("*").alias("n"), F.count_if(F.expr("id_a < id_b and id_a like 'c%' and id_b like 'c%'")).alias("ok")).first()
    assert got.n == got.ok == n * (n - 1) // 2


def versions(n, seed, edits=3, length=40):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    out = []
    for _ in range(n):
        t = base[:]
        for k in rng.sample(range(length), edits):
            t[k] = f"x{rng.randrange(100_000)}"
        out.append(" ".join(t))
    return base, out


def test_many_versions_of_one_text_across_splits(spark):
    base, texts = versions(20_000, 12)
    train = [(f"b{i:05d}", t) for i, t in enumerate(texts)]
    test = [("t0", " ".join(base)), ("t1", texts[0]), ("t2", " ".join(base[:36] + ["q1", "q2", "q3", "q4"])), ("t3", "r s t u v w x y z aa bb cc dd")]
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    stacked = stacked_texts([(0, 0, make(test), "id", "text"), (1, 0, make(train).repartition(6), "id", "text")])
    got = {(r.test_id, r.train_id) for r in cross_split_pairs(stacked, ["text"]).collect()}
    want = {(a, b) for a, s in test for b, t in train if likeness(s.split(), t.split()) >= 0.7}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40_000


def test_many_versions_of_one_text_are_one_group(spark):
    _, texts = versions(3000, 13)
    rng = random.Random(14)
    rows = [(f"b{i:05d}", t) for i, t in enumerate(texts)] + [(f"o{i:03d}", " ".join(f"w{rng.randrange(3000)}" for _ in range(40))) for i in range(500)]
    far, near = texts[0].split(), texts[1].split()
    rows += [("y1", " ".join(far[:33] + ["u1", "u2", "u3", "u4", "u5", "u6", "u7"])), ("y2", " ".join(near[:-1] + ["u8"]))]
    groups = near_duplicate_groups(stacked_texts([(0, 0, spark.createDataFrame(rows, "id string, text string"), "id", "text")]), ["f"]).collect()
    assert {r.group_id for r in groups if r.id.startswith("b")} == {"b00000"} and len(groups) >= 3001


def test_long_lists_give_the_pairs_of_short_ones(spark, monkeypatch):
    rng = random.Random(15)
    posted = []
    for c in range(60):  # signatures of few values, so that all lists are long
        for k in range(6):
            posted.append(((rng.randrange(1, 4) << 20) | k, c, 4 * (8 + c % 5) + 1 + c % 3))
    df = spark.createDataFrame(posted, "v bigint, cls bigint, shape int")
    for cross in (False, True):
        want = {(r.a, r.b) for r in signatures.merge_postings(df, cross, 0.7).collect()}
        with monkeypatch.context() as m:
            m.setattr(signatures, "LONG_LIST", 3)
            m.setattr(signatures, "CELL", 4)
            got = [(r.a, r.b) for r in signatures.merge_postings(df, cross, 0.7).collect()]
        assert set(got) >= want and len(got) == len(set(got))
        values = {}
        for v, c, _ in posted:
            values.setdefault(c, set()).add(v)
        shape = {c: s for _, c, s in posted}
        across = lambda x, y: (x & 1 and y & 2) or (x & 2 and y & 1)
        alike = lambda x, y: min(x // 4, y // 4) >= 0.7 * max(x // 4, y // 4)
        assert all(values[a] & values[b] and alike(shape[a], shape[b]) for a, b in got)
        assert want == {(a, b) for a, b in combinations(range(60), 2) if len(values[a] & values[b]) > 1 and alike(shape[a], shape[b]) and (not cross or across(shape[a], shape[b]))}


def test_p4_found_lists_crowded_classes_whole(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(near_duplicates, "PART", 3)
    text, near = "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q"
    rows = [(f"c{i:02d}", text if i % 2 else "P. " + text[:-2]) for i in range(11)] + [(f"n{i}", near) for i in range(5)] + [("y", near[:-1] + "s"), ("z", "r s t u v w x y z aa bb cc dd"), ("c03", near)]
    spark.createDataFrame(rows, "id string, candidate_message string").write.parquet(f"{tmp_path}/v1_b.parquet")
    spark.createDataFrame([], "id string, leaky_candidate string, safe_rewrite string").write.parquet(f"{tmp_path}/human_boundary.parquet")
    got = [(r.field_name, r.id_a, r.id_b) for r in queries.p4_found(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(("v1_b.candidate_message", a, b) for a, b in brute(rows))


def test_group_of_a_third_of_the_rows_keeps_its_pairs(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(40)]
    rows = [(f"o{i:03d}", " ".join(f"w{rng.randrange(3000)}" for _ in range(40))) for i in range(120)]
    for i in range(60):
        t = base[:]
        for k in rng.sample(range(40), 3):
            t[k] = f"x{rng.randrange(100_000)}"
        rows.append((f"g{i:03d}", " ".join(t)))
    texts = stacked_texts([(0, 0, spark.createDataFrame(rows, "id string, text string"), "id", "text")])
    check_recall({(r.id_a, r.id_b) for r in near_duplicate_pairs(texts, ["f"]).collect()}, rows)


def test_cross_split(spark):
    texts = corpus(5, n=120)
    test, train = [(f"t{i:03d}", t) for i, t in enumerate(texts[::2])], [(f"b{i:03d}", t) for i, t in enumerate(texts[1::2])]
    train += [("copy", test[0][1]), *DIRTY]
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    stacked = stacked_texts([(0, 0, make(test + test[:1]), "id", "text"), (1, 0, make(train), "id", "text")])
    pairs = cross_split_pairs(stacked, ["text"])
    want = {(a, b) for a, s in test for b, t in train if b and t and len(words(t)) >= 12 and likeness(words(s), words(t)) >= 0.7}
    got = {(r.test_id, r.train_id) for r in pairs.collect()}
    assert got <= want and ("t000", "copy") in got and len(got) >= 0.95 * len(want)
    splits = spark.createDataFrame([("test", a, "s") for a, _ in test] + [("train", b, None) for b, _ in train if b], "split string, id string, source string")
    report = {(r.split, r.source): (r.n_records, r.n_overlapping, r.n_pairs) for r in overlap_report(pairs, splits).collect()}
    assert report[("test", "s")] == (60, len({a for a, _ in got}), len(got)) and report[("train", None)][2] == len(got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    texts = stacked_texts([(0, 0, none, "id", "text"), (1, 0, none, "id", "text")])
    assert near_duplicate_pairs(texts, ["f"]).count() == 0
    assert near_duplicate_groups(texts, ["f"]).count() == 0
    assert cross_split_pairs(texts, ["f"]).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [f"v{rng.randrange(40_000)}" for _ in range(60_000)]
    near = long[:]
    for _ in range(500):
        near[rng.randrange(len(near))] = "other"
    df = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(near[::-1])), ("c", "z " * 30_000)], "id string, text string")
    got = near_duplicate_pairs(stacked_texts([(0, 0, df, "id", "text")]), ["f"]).collect()
    assert [(r.id_a, r.id_b) for r in got] == [("a", "b")]


def test_layout_finds_alike_pairs_at_every_size():
    rng = random.Random(16)
    pairs = []
    for _ in range(1500):
        t = [f"v{rng.randrange(10**9)}".encode() for _ in range(40)]
        pairs.append((t[:34], t[:28] + t[34:]))  # likeness 0.7
    sizes = {}
    for n in (0, 1000, 10**5, 10**7, 10**9):
        coordinates, rows = signatures.layout(n, 0.7)
        signer = signatures.Signer(0, coordinates, rows)
        same = (signer.sign([a for a, _ in pairs]) == signer.sign([b for _, b in pairs])).sum(axis=1)
        assert (same >= signatures.MATCHES).mean() > 0.96
        sizes[n] = rows, coordinates
    assert sorted(sizes.values()) == list(sizes.values()) and sizes[10**9][0] == signatures.MOST
    assert signatures.layout(10**6, 1.0)[0] < 5 and signatures.layout(10**6, 0.8)[0] < sizes[10**7][1]


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    texts = [t.encode().split() for t in corpus(7, n=30)]
    whole = signatures.Signer(0, 8, 3).sign(texts)
    monkeypatch.setattr(signatures, "_BLOCK", 7)
    monkeypatch.setattr(signatures, "_ELEMENTS", 45)
    assert np.array_equal(signatures.Signer(0, 8, 3).sign(texts), whole)
    assert np.array_equal(signatures.Signer(0, 8, 3).sign(texts[::-1])[::-1], whole)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert component_labels(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@given(st.text())
def test_word_bytes(text):
    assert [w.decode() for w in word_bytes(text)] == words(text)

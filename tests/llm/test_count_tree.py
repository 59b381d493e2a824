import random

import numpy as np
import pytest

from tallyspark.llm import count_tree, minhash, queries
from tests.conftest import duck, same_rows
from tests.llm.conftest import edited, prose

SF = "/root/testdata/sf0.001"


def expected(rows, monkeypatch):
    monkeypatch.setattr(minhash, "PERCENT", count_tree.PERCENT)
    return sorted((d, n, c) for d, n, c, _ in minhash.components_by_brute_force(rows))


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def families(seed):
    """Near copies, extracts that do not link, chains, shared passages and short texts."""
    r = random.Random(seed)
    base, other, passage = prose(seed, 150), prose(seed + 1, 300), prose(seed + 2, 60)
    texts = [edited(base, seed + i, r.choice([0.005, 0.01, 0.02, 0.03])) for i in range(60)]
    words = other.split()
    texts += [" ".join(words[i : i + 200]) for i in range(0, 100, 4)]
    texts += [prose(seed + 50 + i, 30) + " " + passage for i in range(30)]
    texts += [" ".join(prose(7, 12).split()[: r.randrange(1, 12)]) for _ in range(20)]
    return list(enumerate(texts))


def test_join_matches_brute_force(docs, pairs, monkeypatch):
    assert got(count_tree.jaccard_join(docs)) == expected(pairs, monkeypatch)


@pytest.mark.parametrize("members", [500, 5])
def test_blocks_change_nothing(spark, monkeypatch, members):
    rows = families(11)
    monkeypatch.setattr(count_tree, "BLOCK_WEIGHT", 800 * members)
    monkeypatch.setattr(count_tree, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(count_tree, "POINTS_WEIGHT", 500 * members)
    monkeypatch.setattr(count_tree, "POINTS", members)
    found = got(count_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert found == expected(rows, monkeypatch)


def test_linked_sets_share_a_key():
    r = np.random.default_rng(5)
    few = 0
    for trial in range(3000):
        n = int(r.integers(1, 60)) if trial % 3 else int(r.integers(60, 900))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        # The largest change that still links: some go, some come.
        gone = int(r.integers(0, n // 9 + 1))
        y = x[gone:]
        new = next((k for k in range(n // 4 + 1, -1, -1) if 100 * len(y) >= 80 * (len(x) + k)), None)
        if new is None or not len(y):
            continue
        y = np.unique(np.concatenate([y, r.integers(0, 1 << 63, new, dtype=np.uint64)]))
        assert count_tree.linked(x, y, 80)
        keys, of = count_tree.filed_keys(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert set(keys[of == 0]) & set(keys[of == 1])
        few += 1
    assert few > 2000


def test_bounds_never_exclude_a_link():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(5, 400)), dtype=np.uint64))
        sets += [np.unique(np.concatenate([base[r.random(len(base)) > 0.06], r.integers(0, 1 << 63, int(len(base) * 0.05), dtype=np.uint64)])) for _ in range(9)]
    sets = [s for s in sets if len(s)]
    r.shuffle(sets)
    tree = count_tree.Tree.of_sets([(i, i, s) for i, s in enumerate(sets)])
    label = list(range(len(sets)))
    for a, b in count_tree.tree_links(tree, tree, 80):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    for i in range(len(sets)):
        for j in range(i):
            assert label[i] == label[j] or not count_tree.linked(sets[i], sets[j], 80)


def test_rows_that_share_or_lack_an_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a + " z"), (None, prose(3, 50)), (None, None), (4, a), (5, ""), (5, None)]
    found = [(r.doc_id, r.component_id) for r in count_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (None, None), (4, 1), (5, 5), (5, 5)], key=str)


def test_no_documents(empty):
    assert count_tree.jaccard_join(empty).count() == 0


def test_near_copies_that_share_or_lack_an_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a + " z"), (None, prose(3, 50)), (None, prose(3, 50) + " w"), (None, None), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (None, None, True), (5, 5, True), (5, 5, True)], key=str)
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_copies(docs).collect()]
    assert len(kept) == 6 and (1, a) in kept and (1, b) in kept and sum(d is None and t is not None for d, t in kept) == 1


def test_extracts_of_one_text(spark, monkeypatch):
    words = prose(4, 900).split()
    r = random.Random(9)
    rows = [(i, " ".join(words[k : k + 300])) for i, k in enumerate(r.sample(range(600), 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in minhash.near_duplicates(docs).collect()) == sorted(minhash.components_by_brute_force(rows))


def test_join_matches_sql(spark):
    same_rows(queries.QUERIES["op12_jaccard_join"](spark, SF), duck(SF), queries.ORACLE_SQL["op12_jaccard_join"])

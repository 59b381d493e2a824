import hashlib
import re

from tests.conftest import duck, same_rows

from tallyspark.llm import count_tree, exact_dedup, minhash, queries, rlz
from tallyspark.llm.graph import components

SF = "/root/testdata/sf0.001"


def test_exact_dedup_matches_definition(docs, pairs):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in pairs}
    want = {}
    for d, n in norm.items():
        group = [x for x in norm if norm[x] == n]
        want[d] = (min(group), len(group), d == min(group), hashlib.sha256(n.encode()).hexdigest())
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == want


def test_exact_dedup_matches_sql(spark):
    same_rows(queries.QUERIES["op4_exact_dedup"](spark, SF), duck(SF), queries.ORACLE_SQL["op4_exact_dedup"])


def test_rounds_agree_with_one_grouping(spark):
    rows = [(i % 300, f"d{i % 7}", 1, 2, i, 1) for i in range(900)]
    entries = spark.createDataFrame(rows, "slice int, text_sha256 string, n_chars_norm long, check_hash long, keep_id long, group_size long")
    merged = exact_dedup.merge_runs(entries, 3).collect()
    assert {(r.text_sha256, r.keep_id) for r in merged} == {(f"d{k}", k) for k in range(7)} and sum(r.group_size for r in merged) == 900


def test_near_duplicates_match_brute_force(docs, pairs):
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted(minhash.components_by_brute_force(pairs))


def test_near_duplicates_match_sql(spark):
    same_rows(queries.QUERIES["op3_near_duplicates"](spark, SF), duck(SF), queries.ORACLE_SQL["op3_near_duplicates"])


def test_families_without_a_common_pivot(spark):
    from tests.llm.conftest import edited, prose

    base = prose(5, 120)
    rows = [(i, edited(base, i, 0.035)) for i in range(60)] + [(100 + i, prose(200 + i, 60) + " " + base[:300]) for i in range(20)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(minhash.components_by_brute_force(rows))


def test_families_hold_each_pair_once(spark):
    """A hub with a family in the corpus is no family beside it; one that is a family for others, or has none, stays."""
    near = spark.createDataFrame([(11, 1), (12, 1), (13, 2), (14, 3)], "sid long, hub long")
    far = spark.createDataFrame([(1, 0), (4, 2)], "hub long, family long")
    found = sorted(tuple(r) for r in count_tree._families(near, far).collect())
    assert found == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 2), (11, 0), (12, 0), (13, 2), (14, 3)]


def test_members_of_families_are_joined_once(docs, monkeypatch):
    """The range shuffle reads its rows twice, so the joins before it are written first."""
    plans, chunks = [], count_tree.range_chunks
    monkeypatch.setattr(count_tree, "range_chunks", lambda rows, *a: plans.append((rows.columns, rows._jdf.queryExecution().executedPlan().toString())) or chunks(rows, *a))
    minhash.near_duplicates(docs).collect()
    # Only representatives of blocks are grouped on the way.
    assert sum("Join" in plan for columns, plan in plans if "fine" in columns) == 0 and sum("Join" in plan for _, plan in plans) <= 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert set(found.values()) == {0, 100} and all(found[i] == 0 for i in range(41))


def test_repeats_match_brute_force(docs, pairs):
    got = sorted(tuple(r) for r in rlz.remove_repeats(docs).collect())
    assert got == sorted(rlz.repeats_by_brute_force(pairs))


def test_repeats_match_brute_force_on_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for window, gram in ((35, 8), (12, 4)):
        got = sorted(tuple(r) for r in rlz.remove_repeats(table, window, gram).collect())
        assert got == sorted(rlz.repeats_by_brute_force([(r.doc_id, r.text) for r in table.collect()], window))


def test_anchors_of_many_versions(spark, docs, pairs):
    got = sorted(tuple(r) for r in rlz.remove_repeats(docs, 12, 4, group=1).collect())
    assert got == sorted(rlz.repeats_by_brute_force(pairs, 12))


def test_factor_is_the_longest_match():
    """Three blocks of one group: the first holds words 2 to 8 of the second, words 2 to 6 of the third."""
    import numpy as np

    bodies = [[90, 91, 3, 4, 5, 6, 7, 8, 9, 92], [80, 81, 3, 4, 5, 6, 7, 8, 9, 82], [70, 71, 3, 4, 5, 6, 7, 72, 73, 74]]
    words = np.array(sum(bodies, []), np.uint64)
    firsts, n = np.array([0, 10, 20]), np.array([7, 7, 7])
    starts = np.concatenate([f + np.arange(7) for f in firsts])
    matched, factor = rlz.parse_factors(words, firsts, n, starts, np.array([0, 0, 0]), np.array([True, True, True]), 4)
    assert {int(starts[i]): int(factor[i]) for i in np.flatnonzero(factor)} == {2: 7, 12: 7, 22: 5}
    assert starts[matched].tolist() == [2, 3, 4, 5, 12, 13, 14, 15, 22, 23]
    apart, none = rlz.parse_factors(words, firsts, n, starts, np.array([0, 1, 2]), np.array([True, True, True]), 4)
    assert not apart.any() and not none.any()


def test_factors_alone_decide(monkeypatch):
    """One block meets two others in turn: its second factor crosses the end of the first. A parse that is cut short loses it."""
    import numpy as np
    import pyarrow as pa

    bodies = [[1, 2, 3, 4, 5, 6, 7, 8], [50, 1, 2, 3, 4, 5, 51, 52], [60, 61, 3, 4, 5, 6, 7, 62]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([9, 9, 9]), pa.array([0, 1, 2]), pa.array([i << rlz.TAG_AT for i in range(3)]), pa.array([True, False, False]), pa.array([np.array(b, np.uint64).tobytes() for b in bodies], pa.binary())],
        names=["anchor", "doc_id", "place", "own", "words"],
    )

    def windows():
        out = set()
        for batch in rlz.parse_blocks(4)(iter([rows])):
            for place in batch.column("place").to_pylist():
                low = place & rlz.LOW_MASK
                out |= set(range(low, low + (place >> rlz.COUNT_AT & rlz.COUNT_MASK)))
        return out

    assert windows() == {0, 1, 2, 3}
    whole = rlz.extended
    monkeypatch.setattr(rlz, "extended", lambda *a: np.full(len(a[5]), 5))
    assert windows() == {0, 1, 2, 3}  # as long as the longest match
    monkeypatch.setattr(rlz, "extended", lambda *a: np.where(np.arange(len(a[5])) == 0, 8, whole(*a)))
    assert windows() == {0, 1, 2, 3, 4}  # a factor that is too long takes a window along that no block repeats


def test_texts_that_share_an_id(spark):
    from tests.llm.conftest import prose

    rows = [(1, prose(1, 80)), (1, prose(2, 90)), (2, "more " + prose(2, 60)), (3, prose(3, 70))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 80, 0), (1, 90, 60), (2, 61, 60), (3, 70, 0)]


def test_repeats_match_sql(spark):
    same_rows(queries.QUERIES["op10_repeated_passages"](spark, SF), duck(SF), queries.ORACLE_SQL["op10_repeated_passages"])


def test_kept_text(docs):
    for r in rlz.remove_repeats(docs, texts=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_repeated_ids_and_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in rlz.remove_repeats(rows).collect()) == [(1, 0), (1, 50), (1, 50), (2, 0)]
    assert {r.group_size for r in exact_dedup.exact_dedup(rows).filter("doc_id = 1").collect()} == {1, 2}


def test_one_row_of_equal_rows_stays(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (1, "c d", "z"), (0, "c  d", "w"), (3, None, "n"), (4, "", "m")], "doc_id long, text string, keep_row string")
    got = exact_dedup.drop_copies(rows)
    assert got.columns == rows.columns and sorted((r.doc_id, (r.text or "").split()) for r in got.collect()) == [(0, ["c", "d"]), (1, ["a", "b"]), (3, [])]


def test_empty_and_lone_rows(empty, lone):
    for op in (exact_dedup.exact_dedup, minhash.near_duplicates, rlz.remove_repeats, exact_dedup.drop_copies, minhash.drop_near_copies):
        assert op(empty).count() == 0
        # Every row counts; only the parse of passages leaves out rows without a doc_id.
        assert {r.doc_id for r in op(lone).collect()} == ({5} if op is rlz.remove_repeats else {None, 5})


def test_equal_texts_without_an_id(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (4, "a"), (None, "b  c"), (None, "b c")], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 4, 3, False), (None, 4, 3, False), (4, 4, 3, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(rows).collect()), key=str) == [(4, "a"), (None, "b  c")]


def test_stages_keep_columns(docs):
    for op in (exact_dedup.drop_copies, minhash.drop_near_copies):
        assert op(docs).columns == docs.columns

import json
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import profiles, rates, valuation
from tallyspark.sources import statements


def test_profiles_are_found_by_containment(spark):
    r = random.Random(2)
    names = [f"c{i}" for i in range(9)]
    files = [(f"f{i}", r.sample(names, r.randint(0, 7)) + ["date"]) for i in range(60)]
    wanted = [(f"p{i}", r.sample(names, r.randint(0, 3)) + ["date"] * r.randint(0, 1)) for i in range(12)]
    got = profiles.containing(spark.createDataFrame(files, "path string, header array<string>"), spark.createDataFrame(wanted, "profile string, required array<string>"))
    assert {tuple(x) for x in got.collect()} == {(f, p) for f, h in files for p, c in wanted if c and set(c) <= set(h)}


def test_profile_states(spark):
    files = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", []), ("d", ["x"])], "path string, header array<string>")
    kinds = spark.createDataFrame([("p", ["x"]), ("q", ["x", "y"])], "profile string, required array<string>")
    mapped = spark.createDataFrame([("c", "q")], "path string, profile string")
    rows = {r.path: (r.profile, r.status, r.candidates) for r in profiles.select_profiles(files, kinds, mapped).collect()}
    assert rows == {"a": (None, "ambiguous", ["p", "q"]), "b": (None, "undetected", []), "c": ("q", "mapped", []), "d": ("p", "matched", ["p"])}
    alone = {r.path: (r.profile, r.status) for r in profiles.select_profiles(files, kinds.filter("profile = 'p'")).collect()}
    assert alone["b"] == ("p", "only") and alone["a"] == ("p", "matched")


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ Date ,"Amount, net"\n1,2\n')
    (tmp_path / "b.csv").write_text("\n")
    got = {r.path.rsplit("/", 1)[1]: r.header for r in statements.csv_headers(statements.files(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": ["Date", "Amount, net"], "b.csv": []}


def test_new_rates_value_the_same_rows_as_all_over_again(spark):
    r = random.Random(3)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    ledger = [(i, day(r.randrange(60)), r.choice(["HKD", "USD", "EUR"]), Decimal(r.randrange(1, 900)), None, r.choice([None, None, "matched_exchange"])) for i in range(300)]
    ledger = [(*x[:4], Decimal(1) if x[5] else None, x[5]) for x in ledger]
    rows = spark.createDataFrame(ledger, "id int, date date, posted_currency string, posted_amount decimal(18,2), amount_base decimal(18,2), valuation_source string")
    rate = "currency string, date date, rate decimal(17,8)"
    make = lambda n, c: spark.createDataFrame([(cur, d, Decimal(r.randrange(100, 900))) for cur, d in {(r.choice(c), day(r.randrange(60))) for _ in range(n)}], rate)
    dated, cache, new = make(6, ["USD"]), make(10, ["USD", "EUR"]).cache(), make(4, ["USD", "EUR"]).cache()
    fixed = spark.createDataFrame([("EUR", Decimal(8))], "currency string, rate decimal(17,8)")
    valued = valuation.value_cascade(rows, dated, cache, fixed, "HKD")
    done = rates.apply_observations(valued, dated, cache, new, fixed, "HKD")
    whole = valuation.value_cascade(rows, dated, done.cache, fixed, "HKD")
    key = lambda df: sorted(tuple(x) for x in df.select("id", "amount_base", "valuation_source", "valuation_status", F.coalesce(F.col("rate_date").cast("string"), F.lit(""))).collect())
    assert key(done.rows) == key(whole)
    moved = {a[0] for a, b in zip(key(valued), key(whole), strict=True) if a != b}
    touched = {x.id for x in done.touched.collect()}
    assert moved <= touched and len(touched) < 150
    assert rates.apply_observations(valued, dated, cache, cache.limit(3), fixed, "HKD").touched.count() == 0


def _pages(n, word):
    return {"pages": [[{"text": word, "x0": 1, "top": 1}]] * n}


def test_budgets_refuse_before_the_parse(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps(_pages(3, "abcd")))
    (tmp_path / "t.json").write_text(json.dumps({"pages": [{"tables": [[["ab", None], ["cdefghij"]]]}]}))
    found = statements.files(spark, str(tmp_path), "*.json")
    problems = lambda **limits: {r.path.rsplit("/", 1)[1]: r.problem for r in found.select("path", statements.over_budget(found, **limits).alias("problem")).collect()}
    assert problems(pages=3, chars=12) == {"w.json": None, "t.json": None}
    assert problems(pages=2, chars=1) == {"w.json": "more than 2 pages", "t.json": "more than 1 characters"}
    assert problems(pages=5, chars=11) == {"w.json": "more than 11 characters", "t.json": None}
    with pytest.raises(Exception, match="over budget"):
        statements.within_budget(found, pages=2).select("content").collect()
    rows = statements.text_lines(statements.within_budget(found.filter("path like '%w.json'")))
    assert statements.within_rows(rows, ["page", "line"], 3).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        statements.within_rows(rows, ["page", "line"], 2).collect()


def test_documents_are_read_back_and_in_order(spark, tmp_path):
    from tallyspark.sources import documents

    sources = spark.createDataFrame([(f"s{i}", "n", "r", "c") for i in (2, 1)], "source_id string, namespace string, revision string, contract string")
    records = spark.createDataFrame([(f"s{i % 2 + 1}", f"rec{99 - i}", "f\"ü", "active", i if i % 3 else None, "r", "c", i, 1) for i in range(40)], ", ".join(f"{c} {'long' if 'locator' in c else 'int' if c == 'ordinal' else 'string'}" for c in documents.RECORD))
    documents.write_manifest(sources, records, str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*"))
    keys = [(x["source_id"], x.get("record_id", "")) for p in parts for x in map(json.loads, p.read_text().splitlines())]
    assert keys == sorted(keys) and len(keys) == 42
    a, b = documents.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sources.collect()))
    assert sorted(map(str, b.select(*documents.RECORD).collect())) == sorted(map(str, records.select(*documents.RECORD).collect()))


def test_files_that_change_under_an_import(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.csv", "y"), ("c.csv", "z")):
        (tmp_path / name).write_text(text)
    before = spark.createDataFrame(statements.snapshot(statements.files(spark, str(tmp_path))).collect())
    assert statements.changed_files(before, statements.snapshot(statements.files(spark, str(tmp_path)))).count() == 0
    (tmp_path / "a.csv").write_text("w")
    (tmp_path / "b.csv").unlink()
    (tmp_path / "d.csv").write_text("v")
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in statements.changed_files(before, statements.snapshot(statements.files(spark, str(tmp_path)))).collect()}
    assert got == {"a.csv": "changed", "b.csv": "missing", "d.csv": "new"}


def test_manifest_files_are_compressed(spark, tmp_path):
    from tallyspark.sources import documents

    sources = spark.createDataFrame([("s", "r1", "c1")], "source_id string, revision string, contract string")
    records = spark.createDataFrame([("s", "x", "fp", "active", 1, "r1", "c1", 1, 1)], "source_id string, record_id string, fingerprint string, state string, locator long, origin_revision string, origin_contract string, origin_locator long, ordinal int")
    documents.write_manifest(sources, records, str(tmp_path / "m"), "gzip")
    assert all(f.name.endswith(".gz") for f in (tmp_path / "m").glob("part-*"))
    assert [f.count() for f in documents.read_manifest(spark, str(tmp_path / "m"))] == [1, 1]

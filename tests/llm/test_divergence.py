import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import divergence, queries
from tests.conftest import duck, same_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def expected(rows):
    """The definition, term by term and pair by pair."""
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 2) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:10])}
    return out


def corpus(seed, docs, sources):
    r = random.Random(seed)
    words = ["Ab", "cd", "it's", "É", "zoo-x", "naïve", "q1w", "ß", "漢字", "x\x00y"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for i in range(docs):
        s = min(int(r.expovariate(0.2)), sources - 1)
        text = " ".join(words[min(int(r.expovariate(0.05 + s % 3 / 40)), len(words) - 1)] for _ in range(r.randrange(60)))
        rows.append((i, r.choice([text, text, text, None]), r.choice(["en", "en", "de", None, ""]), f"s{s}" if s else None, None, 1))
    return rows + [(1, "lone words here", "xx", "a", None, 1), (1, "lone words here", "xx", "b", None, 1), (2, None, "xx", "c", None, 1), (3, "big " * 30_000, "en", "s1", None, 1)]


@pytest.mark.parametrize(("heavy_of", "block", "cells"), [(4, 1024, 1 << 18), (1, 3, 50), (1000, 2, 300)])
def test_divergence_matches_definition(spark, monkeypatch, heavy_of, block, cells):
    rows = corpus(3, 500, 30)
    # Workers are used again: they get the settings with the function and are left as they were.
    monkeypatch.setattr(divergence, "BLOCK", block)
    settings = {"HEAVY_OF": heavy_of, "BLOCK": block, "TILE_CELLS": cells}

    def partial(batches, run=divergence.partial_sums, settings=settings):
        from tallyspark.llm import divergence as there

        usual = {k: getattr(there, k) for k in settings}
        try:
            vars(there).update(settings)
            yield from run(batches)
        finally:
            vars(there).update(usual)

    monkeypatch.setattr(divergence, "partial_sums", partial)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == expected(rows)


def test_large_counts_are_exact():
    import numpy as np

    count, total = np.array([3 * 10**12 + 7, 2, 9 * 10**13]), np.array([5 * 10**12 + 11, 10**13 + 3, 9 * 10**13 + 1])
    assert divergence.probability(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_no_documents(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divergence_matches_sql(spark):
    same_rows(queries.QUERIES["op11_source_divergence"](spark, SF), duck(SF), queries.ORACLE_SQL["op11_source_divergence"])

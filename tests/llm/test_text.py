import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyspark.llm import attention_lm, decontam, lang_id, rans, resample, secrets_markov, sp_suffix
from tallyspark.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def test_language_of_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(docs, empty, lone):
    got = {r.doc_id: r for r in lang_id.identify(docs).collect()}
    assert got[1].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[10].lang_pred in ("en", "de")
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert lang_id.identify(empty).count() == 0 and lang_id.identify(lone).first().lang_pred == "und"
    assert lang_id.drop_undetermined(docs).columns == docs.columns and lang_id.drop_undetermined(empty).count() == 0


def test_language_stage_parses_every_document(spark, docs, monkeypatch):
    want = sorted(r.doc_id for r in lang_id.identify(docs).filter("lang_pred <> 'und'").collect())
    assert sorted(r.doc_id for r in lang_id.drop_undetermined(docs).collect()) == want
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in lang_id.drop_undetermined(bare).collect()) == want
    # A table that tells no language apart: the stage follows the automata, not the letters.
    monkeypatch.setattr(lang_id, "_named", lambda m, text: (["und"] * len(text), None, None))
    cloudpickle.register_pickle_by_value(lang_id)
    try:
        assert lang_id.drop_undetermined(docs).count() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(lang_id)


def test_letters_far_apart_are_not_one(spark):
    import pyarrow as pa

    a, b = ("".join(chr(c) for c in range(lo, lo + 400)) for lo in (0x4E00, 0x6E00))
    model = lang_id.Model({"a": [a], "b": [b]})
    costs, _ = model.costs(pa.array([a[100:140], b[300:330], chr(0x8E00) * 20]))
    assert costs[0, 0] < costs[0, 1] and costs[1, 1] < costs[1, 0] and abs(costs[2, 0] - costs[2, 1]) < 0.2


def test_letters_beyond_the_frequent_ones_are_kept_apart(spark):
    a, b = ("".join(chr(c) for c in range(lo, lo + 400)) for lo in (0x4E00, 0x5E00))
    latin = "".join(chr(c) for c in range(0x61, 0x7B)) * 40
    model = lang_id.Model({"a": [a], "b": [b], "l": [latin]})
    import pyarrow as pa

    costs, _ = model.costs(pa.array([a[100:140], b[300:330], "abcd", "ABCDEF" + a[:3]]))
    assert costs.argmin(axis=1).tolist() == [0, 1, 2, 2]
    head, before = lang_id.spelled(np.array([ord("a"), 0x4F05, ord("!")]), model.first, model.second)
    assert before.tolist() == [0, 1, 3, 4] and head[3] == lang_id._GAP


def test_automaton_counts_phrases():
    model = lang_id.Model({"x": ["abcabd"]})
    import pyarrow as pa

    costs, letters = model.costs(pa.array(["abcabd", "abdabc", "zz", "..", ""]))
    phrases = np.round(costs[:, 0] * [6, 6, 2, 1, 1] / model.bits[0]).tolist()
    assert phrases[:3] == [1, 2, 2] and letters.tolist() == [True, True, True, False, False]


def _ids(text):
    from tokenizers import Tokenizer

    _ids.t = getattr(_ids, "t", None) or Tokenizer.from_file(WORDS)
    return np.array(_ids.t.encode(text, add_special_tokens=False).ids + [1], "<u4")


def test_token_files_match_the_library(spark, docs, pairs, tmp_path):
    path = str(tmp_path / "t")
    rans.write_tokens(docs, path, WORDS)
    got, start = {r.doc_id: r for r in rans.read_tokens(spark, path, ids=True).collect()}, 0
    for d, t in sorted(pairs):
        want = _ids(t or "")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes())) and got[d].ids == want.tolist()
        start += len(want)


def test_frames_round_trip_and_checkpoints(empty, spark, tmp_path):
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.full(5, 7, np.uint32), r.integers(0, 49408, 70_001).astype(np.uint32), (r.pareto(1.0, 40_000) * 10 % 3000).astype(np.uint32)):
        frame = rans.Frame(rans.encode(ids, np.array([4]), np.array([len(ids)])))
        assert (frame.decode() == ids).all()
        if len(ids) > rans.BLOCK:
            part = frame.decode_steps(2)
            assert part[:, 0].tolist() == ids[2 * rans.STEPS : 3 * rans.STEPS].tolist()
    data = bytearray(rans.encode(np.arange(3000, dtype=np.uint32), np.array([1]), np.array([3000])))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        rans.Frame(bytes(data))
    rans.write_tokens(empty, str(tmp_path / "e"), WORDS)
    assert rans.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_short_texts_alone():
    """Texts of a few characters, each in a vocabulary that has met nothing before."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("a", "ab", "abc", "abcd", "one t", "two wor", "tiny one", "x y z w"):
        ids = np.concatenate(sp_suffix.Pieces(PIECES)._relaxed([text]))
        assert len(ids) > 0 and lib.decode([int(i) for i in ids]).strip() == text


def test_pieces_match_the_library(docs, pairs, empty, lone):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in sp_suffix.encode(docs, PIECES, ids=True).collect()}
    for d, t in pairs:
        assert got[d].ids == lib.encode(t or "") and got[d].round_trip
    back = {r.doc_id: r.text for r in sp_suffix.decode(sp_suffix.encode(docs, PIECES, ids=True), PIECES).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in pairs)
    assert sp_suffix.encode(empty, PIECES).count() == 0 and {r.doc_id: (r.n_pieces > 0, r.lang) for r in sp_suffix.encode(lone, PIECES, carry=("lang",)).collect()} == {None: (True, None), 5: (False, None)}


def test_long_cut_heap_agrees():
    p = sp_suffix.Pieces(PIECES)
    text = "internationalisationofthesearesults" * 20
    import sentencepiece

    assert np.concatenate(p.fresh([" " + text])).tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


def test_lm_base_is_exact_and_model_learns(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_001, None), (10_002, "")]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    uniform = math.log10(1 / attention_lm.VOCABULARY)
    got = attention_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(r.base_score - want) <= 1e-9 * max(1, abs(want))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]), n)
    outside = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in outside) > 0.5 * uniform * sum(len(_ids(dict(rows)[r.doc_id])) for r in outside)


def test_lm_beats_the_base_on_held_out_text(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = attention_lm.score_texts(table, WORDS).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_learns_from_long_documents_and_counts_all(spark):
    long = " ".join(["red green blue"] * 2000)
    rows = spark.createDataFrame([(i, long) for i in range(12)], "doc_id long, text string").repartition(3)
    got = attention_lm.score_texts(rows, WORDS).collect()
    assert len(long) > 20_000 and all(r.score / len(_ids(long)) > -0.5 for r in got)


def test_lm_subword_counts_are_whole(spark, docs, pairs):
    tokens = docs.selectExpr("doc_id AS row", "doc_id", "coalesce(text, '') AS text").mapInArrow(attention_lm._tokenized(WORDS), "row long, doc_id long, text string, ids binary")
    n, windows = attention_lm.subword_counts(tokens)
    want = [np.append(_ids(t or "")[:-1], attention_lm.END_ID) for _, t in pairs]
    assert (n == np.bincount(np.concatenate(want), minlength=attention_lm.VOCABULARY)).all()
    assert windows == sum(-(-len(w) // attention_lm.STRIDE) for w in want)


def test_lm_windows_score_every_token_once():
    begin, row = attention_lm.windows(np.array([1, 32, 33, 80]))
    assert begin.tolist() == [0, 1, 33, 65, 66, 98, 130] and row.tolist() == [0, 1, 2, 2, 3, 3, 3]


def test_lm_empty(empty, lone):
    assert attention_lm.score_texts(empty, WORDS).count() == 0
    assert {r.doc_id: (r.n_tokens, r.held_out) for r in attention_lm.score_texts(lone, WORDS).collect()} == {None: (3, False), 5: (1, False)}


def test_lm_rows_that_share_an_id(spark):
    texts = [(7, "one unknown"), (7, "three unknown words there"), (7, "three unknown words there"), (None, "one unknown")]
    rows = spark.createDataFrame([*texts, *((100 + i, "some text to learn from") for i in range(20))], "doc_id long, text string")
    got = sorted((r for r in attention_lm.score_texts(rows, WORDS).collect() if r.doc_id in (7, None)), key=lambda r: (r.n_tokens, r.doc_id is None))
    assert [r.n_tokens for r in got] == [3, 3, 5, 5]
    assert all(math.isclose(a.base_score, b.base_score) for a, b in (got[:2], got[2:])) and got[2].base_score < got[0].base_score - 0.5


def test_lm_scores_match_plain_loops():
    """Every probability again, key by key, from the distributions and weights of a fitted model."""
    r = np.random.default_rng(3)
    texts = [np.append(r.integers(0, 300, int(k)), attention_lm.END_ID) for k in (1, 5, 40, 70)]
    ids, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    n = np.bincount(ids, minlength=attention_lm.VOCABULARY).astype(float)
    m = attention_lm.Model(n, np.zeros((attention_lm.EMBEDDED - attention_lm.SINGLES) * (attention_lm.PROFILE + 1), np.int64))
    cells = np.unique(r.integers(0, attention_lm.TABLES * attention_lm.EMBEDDED * attention_lm.CLASSES, 4000))
    m.learn(cells, r.integers(1, 9, len(cells)))
    m.p["bilinear"] = r.normal(0, 0.3, m.p["bilinear"].shape).astype(np.float32)
    m.p["key"] = r.normal(0, 0.5, m.p["key"].shape).astype(np.float32)
    value = m.value.reshape(attention_lm.TABLES, attention_lm.EMBEDDED + 1, attention_lm.CLASSES).astype(float)
    got, at = m.score(ids, sizes), 0
    for t in texts:
        past = [attention_lm.EMBEDDED - 1, *m.row[t[:-1]]]
        for i, token in enumerate(t):
            block = i - i % attention_lm.QUERIES
            keys = [(k, past[k], i - k) for k in range(max(0, block - attention_lm.CONTEXT), i + 1)] + [(None, attention_lm.EMBEDDED, None)]
            # Places of the block that do not exist offer what all text does, as far as they lie before the query.
            keys += [(None, attention_lm.EMBEDDED, i - k) for k in range(block - attention_lm.CONTEXT, 0)]
            top = bottom = 0.0
            for _, row, gap in keys:
                near = attention_lm.CONTEXT + attention_lm.QUERIES if gap is None else gap
                e = m.embedding[past[i]] @ m.p["bilinear"] @ m.embedding[row] + m.p["key"][row] + m.p["near"][near]
                w = math.exp(min(float(e), 60.0))
                top, bottom = top + w * value[min(near, attention_lm.TABLES - 1), row, m.classes[token]], bottom + w
            assert abs(got[at] - (math.log(top / bottom) + m.within[token])) < 2e-3
            at += 1


def test_lm_gradients_are_slopes():
    """The slope of the mean loss by each kind of parameter, against differences of the score."""
    r = np.random.default_rng(4)
    sizes = np.array([40, 7, 33])
    ids = r.integers(0, 200, int(sizes.sum()))
    m = attention_lm.Model(np.bincount(ids, minlength=attention_lm.VOCABULARY).astype(float), np.zeros((attention_lm.EMBEDDED - attention_lm.SINGLES) * (attention_lm.PROFILE + 1), np.int64))
    cells = np.unique(r.integers(0, attention_lm.TABLES * attention_lm.EMBEDDED * attention_lm.CLASSES, 4000))
    m.learn(cells, r.integers(1, 9, len(cells)))
    m.p["bilinear"] = r.normal(0, 0.1, m.p["bilinear"].shape).astype(np.float32)
    begin, row = attention_lm.windows(sizes)
    low = np.cumsum(sizes) - sizes
    x, target, exists, _ = m.placed(ids, begin, low[row], (low + sizes)[row])
    grad = m.gradients(x, target, exists / np.float32(len(ids)), m.asked())
    loss = lambda: -float((m.score(ids, sizes) - m.within[ids]).astype(float).mean())
    for name, at in (("bilinear", (2, 5)), ("key", int(x[0, -1])), ("key", attention_lm.EMBEDDED), ("near", 1), ("near", -1)):
        kept, around = m.p[name][at], []
        for step in (0.05, -0.05):
            m.p[name][at] = kept + step
            around.append(loss())
        m.p[name][at] = kept
        assert abs((around[0] - around[1]) / 0.1 - grad[name][at]) < 1e-3 + 0.02 * abs(grad[name][at])


def test_lm_counts_of_what_follows_are_whole():
    """Short rows too; what travels holds entries that are not 0 alone, whatever their size."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    rows, classes = r.integers(0, attention_lm.EMBEDDED, attention_lm.VOCABULARY), r.integers(0, attention_lm.CLASSES, attention_lm.VOCABULARY)
    for lengths in ((1,), (2,), (1, 3, 2), (9, 1, 40)):
        texts = [r.integers(0, attention_lm.VOCABULARY, k) for k in lengths]
        want: Counter = Counter()
        for t in texts:
            past = [attention_lm.EMBEDDED - 1, *rows[t[:-1]]]
            for i in range(len(t)):
                for d in (0, 1, *attention_lm.LATER):
                    if d <= i:
                        want[(min(d, attention_lm.TABLES - 1) * attention_lm.EMBEDDED + int(past[i - d])) * attention_lm.CLASSES + int(classes[t[i]])] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([t.astype(np.uint16).tobytes() for t in texts], pa.binary())], names=["ids"])
        got = {c * attention_lm.CHUNK + int(a): int(v) for b in attention_lm._followed(rows, classes)(iter([batch])) for c, at, x in attention_lm._unpacked(b) for a, v in zip(at, x, strict=True)}
        assert got == dict(want)
    for few in ([3], [127, -128], [128], [-129], [2**40, -(2**62)]):
        whole = np.zeros(attention_lm.CHUNK, np.int64)
        whole[5 : 5 + len(few)] = few
        ((chunk, at, x),) = attention_lm._unpacked(attention_lm._packed({7: whole}))
        assert (chunk, at.tolist(), x.tolist()) == (7, list(range(5, 5 + len(few))), few)


def test_lm_heavy_words_are_found():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:0], np.array([0, 1, 2, 3, 2**64 - 1], np.uint64)):
        words = np.concatenate((some, keys[::7] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))
        at, known = attention_lm._finder(some)(words)
        assert (known == np.isin(words, some)).all() and (some[at[known]] == words[known]).all()


def test_secrets_base_spans(docs, pairs, empty, lone):
    texts = dict(pairs)
    rows = {r.doc_id: r for r in secrets_markov.find_secrets(docs).collect()}
    assert rows.keys() == texts.keys()
    for d, r in rows.items():
        want = secrets_markov.base_spans_by_brute_force(texts[d])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == ([x for x in text.split(",") if x])
    assert secrets_markov.find_secrets(empty).count() == 0 and secrets_markov.find_secrets(lone).first().spans == ""


def test_secrets_model_spans_match_plain_scores(spark, docs, pairs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    weights = secrets_markov.train(table)
    plan = secrets_markov.find_secrets(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    found = 0
    for r, text in zip(secrets_markov.find_secrets(table.orderBy("doc_id")).collect(), [x.text or "" for x in table.orderBy("doc_id").collect()], strict=True):
        base, want = secrets_markov.base_spans_by_brute_force(text), []
        for m in re.finditer(secrets_markov.CANDIDATE, text):
            codes = [0, *(secrets_markov.ALPHABET.index(c) + 1 for c in m[0])]
            score = sum(weights[a * secrets_markov.SIDE + b] for a, b in zip(codes, codes[1:], strict=False))
            if score > secrets_markov.THRESHOLD and not any(a < m.end() and b > m.start() for _, a, b in base):
                want.append(("model", m.start(), m.end()))
        spans = sorted((a, secrets_markov.KINDS.index(k), b) for k, a, b in base + want)
        assert r.spans == ",".join(f"{secrets_markov.KINDS[k]}:{a}:{b}" for a, k, b in spans) and r.n_model == len(want)
        found += len(want)
    assert found > 0


def test_secrets_of_repeated_ids_and_short_tokens(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(90_001, "password: hunter22"), (90_001, "password: hunter22"), (None, "password: hunter22"), (90_002, "the x7Kq9ZbW2mVt4RpL8 key")]
    rows = table.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_assign, r.spans, r.n_model) for r in secrets_markov.find_secrets(rows).filter("doc_id > 90000").collect())
    assert got == [(90_001, 1, "assign:0:18", 0)] * 2 + [(90_002, 0, "model:4:21", 1)]


def test_secrets_model_tells_random_from_ordinary(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(90_001, "key Zx8Kq2LmW9vT4rYb7NpC3dFg6HjS1aQe end"), (90_002, "a thoroughly_ordinary_identifier_name here")], "doc_id long, text string")
    rows = {r.doc_id: r.n_model for r in secrets_markov.find_secrets(table.union(more)).filter("doc_id > 90000").collect()}
    assert rows == {90_001: 1, 90_002: 0}


def _question(name, number, unit):
    return f"A farmer called {name} carries {number} {unit} of grain from the barn to the mill and back again before the evening bell rings over the quiet village street"


def test_decontamination_templates(spark, empty):
    bench = spark.createDataFrame([(1, _question("Anna", 12, "kg")), (2, "too short"), (3, None)], "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(30))
    texts = {10: filler + ". " + _question("Anna", 12, "kg") + " " + filler, 11: filler + ". " + _question("Bertil", 3.5, "pounds"), 12: filler, 13: None, 14: "too short"}
    rows = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(rows, bench).collect()}
    assert set(got) == {(10, 1), (11, 1)} and all(r.n_consistent == r.n_slots > 0 for r in got.values())
    assert sorted(r.doc_id for r in decontam.drop_contaminated(rows, bench).collect()) == [12, 13, 14]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(rows, bench.limit(0)).count() == 0


def test_decontamination_of_repeated_items(spark):
    bench = spark.createDataFrame([(1, _question("Anna", 12, "kg"))], "item_id long, text string")
    asked = [_question("Anna", 12, "kg"), _question("Bertil", 3.5, "pounds"), _question("Cecilia", 40, "tons")]
    texts = {10: ". ".join(asked[:2]), 11: ". ".join(asked[1:]), 12: ". so ".join(asked), 13: ". ".join(asked[:1] * 3)}
    got = {r.doc_id: r for r in decontam.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got.keys() == texts.keys() and all(r.n_consistent == r.n_slots > 0 for r in got.values())


def test_decontamination_of_items_with_few_literals(spark):
    items = [(1, "What is 7 times 8?"), (2, "Add 12 and 30 then 45, 60 and 75: take 81 from 99 3.5 7 4 11 for Anna 12 5"), (3, "Is 5 more than 4?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {10: "so what is 7 times 8, they asked", 11: "And what is 7 times 9? Nobody knew", 12: "Well. " + items[1][1] + ". Then on.", 13: "Is 5 more than 4?", 14: "is 5 more"}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got == {(10, 1), (12, 2), (13, 3)}


def test_decontamination_slots_agree_both_ways(spark):
    ask = "Then {} walked {} miles with {} who had walked {} miles along the river, and who was faster of them"
    bench = spark.createDataFrame([(1, ask.format("Anna", 12, "Bert", 7)), (2, "Capital of France?")], "item_id long, text string")
    texts = {10: ask.format("Zoe", 5, "Yann", 9), 11: ask.format("Zoe", 5, "Zoe", 5), 12: "He asked: capital of France? Paris", 13: "capital of Spain"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(rows, bench).collect()} == {(10, 1), (12, 2)}


def test_decontamination_matches_plain_windows(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = lambda t: [x for x in (re.sub(r"[^\w]", "", y.lower()) for y in (t or "").split()) if x]
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    items = {r.item_id: grams(clean(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for g in [grams(clean(r.text))] for i, b in items.items() if len(g & b) >= decontam.COVERAGE * len(b)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want


def test_resampling_prefers_the_target(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 40) + (" vile" if i % 5 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in resample.resample(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[i] == (i % 5 != 0) for i in range(400))
    assert sum(r.kept for r in resample.resample(docs, labels, k=17).collect()) == 17


def test_resampling_weights_are_log_ratios(spark):
    from tests.llm.conftest import prose

    texts = {i: prose(i, 12) + (" good" if i % 2 else " plain") for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in resample.resample(docs, labels, share=0.5).collect()}
    # The target over all text, by counts of distinct words, pairs and the share of repeated words.
    sets = {}
    for i, t in texts.items():
        w = t.split()
        repeats = sum(a == b for a, b in zip(w, w[1:], strict=False))
        sets[i] = {*w, *((a, b) for a, b in zip(w, w[1:], strict=False) if a != b), ("share", min(repeats * resample.SHARES // len(w), resample.SHARES - 1))}
    raw, target = Counter(x for s in sets.values() for x in s), Counter(x for i, s in sets.items() if i < 60 and i % 2 for x in s)
    room = resample.SMOOTHING * resample.BUCKETS
    log = lambda c, x: math.log((c[x] + resample.SMOOTHING) / (sum(c.values()) + room))
    close = [abs(got[i].log_weight - sum(log(target, x) - log(raw, x) for x in s)) < 1e-3 for i, s in sets.items() if got[i].log_weight > -resample.REJECTED]
    assert sum(close) >= 0.9 * len(close) > 0  # a few documents hold words that share a bucket
    kept = sorted(got.values(), key=lambda r: (-r.gumbel_key, r.doc_id))[: sum(r.kept for r in got.values())]
    assert all(r.kept for r in kept) and 0 < len(kept) < len(got)


def test_noise_has_its_say(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = resample.resample(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), share=0.5).collect()
    fine = [r for r in rows if r.log_weight > -resample.REJECTED]
    kept = {r.doc_id for r in fine if r.kept}
    heaviest = {r.doc_id for r in sorted(fine, key=lambda r: -r.log_weight)[: len(kept)]}
    # A sort by weight would keep the heaviest alone, a draw without weights half of them.
    assert 0.6 * len(kept) < len(kept & heaviest) < 0.9 * len(kept)


def test_gumbel_noise_draws_in_proportion(spark):
    weight = {0: 0.0, 1: math.log(3.0)}
    drawn = spark.range(40_000).select((F.col("id") % 2).alias("kind"), (F.floor(F.col("id") / 2)).alias("pair"), resample.gumbel(F.col("id")).alias("g"))
    keyed = drawn.withColumn("key", F.col("g") + F.when(F.col("kind") == 1, weight[1]).otherwise(weight[0]))
    share = keyed.groupBy("pair").agg(F.max_by("kind", "key").alias("won")).agg(F.avg("won")).first()[0]
    assert abs(share - 0.75) < 0.01


def test_top_k_with_ties(spark):
    keyed = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "doc_id long, key double")
    for k in (0, 1, 15, 99, 100):
        kept = sorted(r.doc_id for r in resample.top_k(keyed, k, bins=4).filter("kept").collect())
        assert kept == sorted(sorted(range(100), key=lambda i: (-(i // 10), i))[:k])


def test_resampling_empty(empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample.resample(empty, none).count() == 0
    assert resample.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first().kept


def test_public_vocabularies_are_a_parameter():
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES

import hashlib
import re

import corpus_pipeline
import numpy as np
import sentencepiece

from tallyspark.llm import minhash
from tallyspark.llm.common import tokenizer_file
from tallyspark.llm.decontam import COVERAGE

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    import zlib

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    left = {d: t for d, t in rows.items() if any(ch.isalpha() for ch in t or "")}
    norm: dict[str, int] = {}
    for d in sorted(left):
        norm.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]).encode()).hexdigest(), d)
    left = {d: left[d] for d in norm.values()}
    left = {d: left[d] for d, _, _, kept in minhash.components_by_brute_force(sorted(left.items())) if kept}
    clean = lambda t: [x for x in (re.sub(r"[^\w]", "", y.lower()) for y in t.split()) if x]
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    items = [grams(clean(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(len(grams(clean(t)) & b) >= COVERAGE * len(b) for b in items)}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = {d: (len(ids := lib.encode(t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in left.items()}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_rows_of_every_kind(spark, docs, empty, tmp_path):
    """Null and repeated ids, null, empty and very long texts, extra columns with clashing names, an empty table."""
    from tests.llm.conftest import prose

    spark.createDataFrame([(1, prose(2, 60)), (2, "short"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(61, 40), "en", "s", 1, "x", 2, "k"), (7, prose(62, 40), None, None, None, None, None, None), (7, prose(63, 40), "de", "s", 1, "x", 2, "k"), (8, prose(64, 120_000), "en", "s", 1, "x", 2, "k"), (None, None, None, None, None, None, None, None)]
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == table.columns
            table = spark.createDataFrame(out.collect(), table.schema)
            assert stage(spark, empty, str(tmp_path)).count() == 0
    left = out.collect()
    texts = {r.doc_id: r for r in left}
    assert sum(r.doc_id == 7 for r in left) == 2 and sum(r.doc_id is None for r in left) == 1 and texts[8].n_pieces > 120_000
    assert all(r.round_trip for r in left) and out.columns == ["doc_id", "n_pieces", "ids_crc32", "round_trip", "source"]

import zlib
from collections import Counter

import corpus_pipeline
from pathweave.llm.mixing import mix
from tests.llm.conftest import as_dir
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check_bins


def test_stages_match_brute_force(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    folder = as_dir(docs, tmp_path)
    kept, frame = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        kept[name] = frame.collect()
    clean = {r.doc_id: r.text for r in kept["quality_rules"]}
    largest = {}
    for i, t in clean.items():
        largest[t] = max(i, largest.get(t, i))
    assert {r.doc_id for r in kept["exact_dedup"]} == set(largest.values())
    root, _ = brute([(r.doc_id, r.text) for r in kept["exact_dedup"]])
    assert {r.doc_id for r in kept["near_dedup"]} == set(root.values())
    near = spark.read.parquet(f"{folder}/near_dedup")
    assert {r.doc_id for r in kept["mixing"]} == {r["_row"].doc_id for r in mix(near).where("in_mix").collect()}
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mixing"]}
    check_bins(kept["packing"])
    again = corpus_pipeline.run(spark, folder).collect()
    digest = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(again) == digest(kept["packing"]) and zlib.crc32(b"") == 0


def test_empty_table(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, as_dir(empty, tmp_path)).count() == 0

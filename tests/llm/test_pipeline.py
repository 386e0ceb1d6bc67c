import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import mixing
from tests_llm_truth import fingerprint, least_ids, measures


def words(k, n, seed):
    rng = np.random.default_rng([k, seed])
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_stages_and_run(spark, tmp_path):
    items = [(i, " ".join(words(i, 40, 7)) + ". The end.") for i in range(5)]
    rows = []
    for i in range(200):
        text = words(i, 120, 1)
        if i % 20 == 3:
            text[30:30] = items[i % 5][1].split()
        if i % 25 == 4:
            text = ["short"]
        if i % 30 == 7:
            text = words(7, 120, 1)
        rows.append((i, " ".join(text), "en", f"s{i % 4}" if i % 3 else "hot", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # the brute-force version, stage by stage
    texts = {r[0]: r[1] for r in rows}
    kept = {i for i in texts if not measures(texts[i])[-1]}
    least = least_ids(sorted(kept), [fingerprint(texts[i]) for i in sorted(kept)], 4)
    single = {i for i in kept if least[i] == i}
    clean = {i for i in single if i % 20 != 3}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, single, clean), strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.doc_id for r in docs.collect()) == sorted(want), name
    taken = {r.doc_id: len(r.copies) for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i in sorted(taken):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        for _ in range(taken[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

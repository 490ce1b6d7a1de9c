"""The pipeline's stages on a small table: what is planted goes, what is clean stays."""

from collections import Counter

import numpy as np

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an"], 3)) + str(rng.integers(0, 99)) for _ in range(n))
    rows = [(k, text(60), "en", f"s{k % 3}", 1) for k in range(300)]
    rows += [(300 + k, rows[0][1], "en", "s0", 1) for k in range(30)]
    leak = text(40)
    rows += [(400, text(20) + " " + leak + " " + text(20), "en", "s1", 1), (401, "123 456", "en", "s1", 1), (402, None, "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(330)) | {400}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    n = Counter(r.doc_id for r in out)
    assert not set(n) & (set(range(300, 330)) | {400, 401, 402}) and 0.8 * 300 < len(out) < 2 * 300 and max(n.values()) <= 2
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]

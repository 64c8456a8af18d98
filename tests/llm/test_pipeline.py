"""The pipeline against its stages' brute-force versions on a small corpus."""

import random

import corpus_pipeline

from .conftest import prose
from .test_duplicates import brute_classes


def test_stages_in_order_take_effect(spark, make, tmp_path):
    rng, rows, marks = random.Random(9), [], []
    item = prose(77, 40)
    for i in range(400):
        words = prose(5000 + i, 70).split()
        if i % 8 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "snarkle")
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        marks.append((i, int(i % 8 == 0)))
    rows.append((1001, rows[1][1], "en", "s1"))  # a copy
    rows.append((1002, rows[2][1] + " more", "en", "s2"))  # a near copy
    rows.append((1003, prose(6001, 30) + ". " + item, "en", "s0"))  # a leak
    rows.append((1004, prose(6002, 30) + " token = abcdefghijklmnop1", "en", "s0"))  # a secret
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    make(rows).select(base).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == base
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i, *_ in rows} - set(range(0, 400, 8))
    assert set(seen["toxicity"]) == clean
    texts = {r[0]: r[1] for r in rows}
    classes = brute_classes([(i, texts[i]) for i in sorted(clean)])
    assert set(seen["near_dedup"]) == {i for i in clean if classes[i] == i} == clean - {1001, 1002}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {1003}
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert seen["secrets"][1004].endswith("[assign]") and seen["secrets"][5] == texts[5]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(seen["secrets"])
    assert sum(r["taken"] for r in out) > 0.9 * 1.5 * sum(r["size"] for r in out)

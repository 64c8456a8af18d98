"""The incremental index against a rebuild."""

import os

from pyspark.sql import functions as F

from quayline.operators import chunk_index


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def listed(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(spark, path, provider="p"):
    return sorted(map(str, chunk_index.load(spark, path, provider).collect()))


def test_second_sync_equals_a_rebuild_and_leaves_the_rest(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    embed = lambda df: df.select("content_hash", F.array(F.length("content").cast("float")).alias("vector"))
    first = {f"f{k}": f"part one of {k}\n\nshared part\n\n" + "x" * (k % 7) for k in range(30)} | {"blank": " \n\t\n", "none": None}
    second = {k: v for k, v in first.items() if k not in ("f3", "f4")} | {"f5": "another text", "f6": "", "new": "shared part"}
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    try:
        did = chunk_index.sync(files(spark, first), a, "p", embed, tokens=4, overlap=0)
        assert (did["files"], did["changed"], did["removed"]) == (32, 32, 0) and did["embedded"] == chunk_index.load(spark, a, "p").count()
        before = listed(tmp_path / "a" / "entries")
        did = chunk_index.sync(files(spark, second), a, "p", embed, tokens=4, overlap=0)
        assert (did["files"], did["changed"], did["removed"], did["embedded"]) == (31, 3, 2, 1) and did["buckets"] <= 5
        after = listed(tmp_path / "a" / "entries")
        assert all(after[f] == t for f, t in before.items())  # nothing that was there is written again
        assert len({f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}) <= did["buckets"]
        chunk_index.sync(files(spark, second), b, "p", embed, tokens=4, overlap=0)
        assert rows(spark, a) == rows(spark, b)
        assert {r["file"] for r in chunk_index.load(spark, a, "p").filter("content = 'shared part'").collect()} == {"new"}  # the last writer owns it
        did = chunk_index.sync(files(spark, second), a, "p", embed, tokens=4, overlap=0)
        assert (did["changed"], did["buckets"], did["embedded"]) == (0, 0, 0)
        did = chunk_index.sync(files(spark, second), a, "q", embed, tokens=4, overlap=0)  # another provider
        assert did["embedded"] == len(rows(spark, a, "q")) and all("vector=None" not in r for r in rows(spark, a, "q"))
        chunk_index.sync(files(spark, {"t": "a talk"}), a, source="sessions", tokens=4, overlap=0)
        assert len(rows(spark, a)) == len(rows(spark, b)) + 1
        chunk_index.sync(files(spark, {}), a, tokens=4, overlap=0)
        assert [r["file"] for r in chunk_index.load(spark, a).collect()] == ["t"]
        chunk_index.sync(files(spark, {}), a, source="sessions", tokens=4, overlap=0)
        assert rows(spark, a) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_sync_keeps_no_second_copy_of_texts(spark, tmp_path, monkeypatch):
    kept, whole = [], chunk_index.materialise
    monkeypatch.setattr(chunk_index, "materialise", lambda df, label: kept.append(df.columns) or whole(df, label))
    path = f"file://{tmp_path}/c"
    chunk_index.sync(files(spark, {"a": "one\n\ntwo", "b": "", "c": "three"}), path, tokens=1, overlap=0)
    did = chunk_index.sync(files(spark, {"a": "one\n\n2", "b": "", "d": None}), path, tokens=1, overlap=0)
    assert (did["files"], did["changed"], did["removed"]) == (3, 2, 1)
    assert kept and not any({"text", "content"} & set(c) for c in kept)
    held = chunk_index.entries(spark, path).select("file", "chunk", "content").collect()
    assert sorted(map(tuple, held), key=str) == sorted([("a", 0, "one"), ("a", 1, "2"), ("b", None, None), ("d", None, None)], key=str)

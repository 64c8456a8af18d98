"""An incremental index of file chunks: versioned Parquet, of which a sync rewrites only the buckets of changed files.

``entries`` has one row a chunk of a file, in buckets of files; ``vectors`` one row a content hash and
provider, appended to; ``manifest`` says which version of each bucket counts, and is written last, so
a sync that fails leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.operators import bitfilter
from quayline.operators.retrieval import chunks
from quayline.storage import materialise

BUCKETS = 64
ENTRIES = "file string, digest string, chunk int, start_line int, end_line int, content string, content_hash string, source string"
VECTORS = "content_hash string, vector array<float>, provider string, version int"
MANIFEST = "bucket int, version int, v int"

Embed = Callable[[DataFrame], DataFrame]  # (content_hash, content) -> (content_hash, vector)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # nothing has been written there yet
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The index's version and that of each of its buckets; no more than BUCKETS numbers."""
    rows = _read(spark, f"{path}/manifest", MANIFEST)
    newest = rows.agg(F.max("v")).first()[0]
    return newest or 0, {r["bucket"]: r["version"] for r in rows.filter(F.col("v") == F.lit(newest)).collect()} if newest else {}


def entries(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The chunks that count, with their bucket; ``only`` those of some buckets."""
    at = [f"{path}/entries/version={v}/bucket={b}" for b, v in versions(spark, path)[1].items() if b >= 0 and (only is None or b in only)]
    kind = f"{ENTRIES}, version int, bucket int"
    return (spark.read.schema(kind).option("basePath", f"{path}/entries").parquet(*at) if at else spark.createDataFrame([], kind)).drop("version")


def load(spark: SparkSession, path: str, provider: str | None = None) -> DataFrame:
    """One row a content hash, that of the last file that holds it: content_hash, file, source, start_line, end_line, content, vector.

    The vector is the provider's, null where there is none: vectors of another provider never count.
    """
    held = entries(spark, path).filter("content_hash IS NOT NULL")
    owned = ("file", "source", "start_line", "end_line", "content")
    last = held.groupBy("content_hash").agg(*[F.max_by(c, F.struct("file", "chunk", "source")).alias(c) for c in owned])  # one each: what is not asked for isn't read
    known = _read(spark, f"{path}/vectors", VECTORS).filter(F.col("provider") == F.lit(provider)).select("content_hash", "vector").dropDuplicates(["content_hash"])
    return last.join(known, "content_hash", "left")


def sync(files: DataFrame, path: str, provider: str | None = None, embed: Embed | None = None, source: str = "memory", tokens: int = 400, overlap: int = 80, force: bool = False) -> dict[str, int]:
    """Bring the index at ``path`` to the files (file, text) of this source; what it did: files, changed, removed, buckets, embedded.

    A file whose text is as it was is not cut again; its bucket is rewritten only if another file of
    it changed. Files that are gone lose their chunks; files of other sources stay. Only hashes
    without a vector of this provider are embedded, so changing the provider embeds all of them anew.
    ``force`` cuts every file again.
    """
    spark = files.sparkSession
    version, at = versions(spark, path)
    told = files.select("file", F.coalesce("text", F.lit("")).alias("text")).withColumns({"digest": F.sha2("text", 256), "bucket": F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int")})
    known = entries(spark, path).filter(F.col("source") == source).select("file", "digest", "bucket").distinct()
    changed = told if force or not at else told.join(known.select("file", "digest"), ["file", "digest"], "left_anti")
    gone = materialise(known.join(told.select("file"), "file", "left_anti").select("file", "bucket"), "index-gone")

    cut = chunks(changed, "file", "text", tokens, overlap, keep=("digest", "bucket"), bare=True)  # a file without chunks keeps one row
    columns = ("file", "digest", "chunk", "start_line", "end_line", "content", "content_hash", "source", "bucket")
    made_at, kind = f"{path}/entries/version={version + 1}", f"{ENTRIES}, bucket int"
    cut.withColumn("source", F.lit(source)).select(*columns).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(made_at)
    fresh = _read(spark, made_at, kind).select(*columns)  # of the files that are there now
    changed = fresh.filter("chunk IS NULL OR chunk = 0").select("file", "bucket")
    touched = sorted(r["bucket"] for r in changed.select("bucket").union(gone.select("bucket")).distinct().collect())  # at most BUCKETS
    if touched:
        held = entries(spark, path, touched)
        away = changed.select("file").union(gone.select("file")).withColumn("source", F.lit(source))
        own = materialise(held.select("file", "source").distinct().join(away, ["file", "source"], "left_anti"), "index-stays")
        if not own.isEmpty():  # contents of files that leave are not shuffled: the filter drops them, the join decides
            may_stay = bitfilter.may_hold(own.select(F.struct("file", "source").alias("own")))
            stays = held.filter(may_stay(F.struct("file", "source"))).join(own, ["file", "source"], "left_semi")
            stays.select(*columns).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(made_at)
        full = {r["bucket"] for r in _read(spark, made_at, kind).select("bucket").distinct().collect()}
        at = {b: v for b, v in at.items() if b not in touched} | {b: version + 1 for b in touched if b in full}

    embedded = 0
    if embed is not None:
        held = _read(spark, f"{path}/vectors", VECTORS).filter(F.col("provider") == F.lit(provider)).select("content_hash")
        texts = entries(spark, path).select("content_hash", "content") if held.isEmpty() else fresh.limit(0).select("content_hash", "content")  # a new provider
        texts = texts.unionByName(fresh.select("content_hash", "content")).filter("content_hash IS NOT NULL")
        wanted = texts.dropDuplicates(["content_hash"]).join(held, "content_hash", "left_anti")
        made = materialise(embed(wanted), "index-vectors")
        embedded = made.count()
        if embedded:
            made.select("content_hash", F.col("vector").cast("array<float>").alias("vector")).withColumns({"provider": F.lit(provider), "version": F.lit(version + 1)}).write.partitionBy("provider", "version").mode("append").parquet(f"{path}/vectors")

    if touched:
        spark.createDataFrame(sorted(at.items()), "bucket int, version int").coalesce(1).withColumn("v", F.lit(version + 1)).write.partitionBy("v").mode("append").parquet(f"{path}/manifest")
        if not at:  # an empty version has no row of its own
            spark.createDataFrame([(-1, 0, version + 1)], MANIFEST).write.partitionBy("v").mode("append").parquet(f"{path}/manifest")
    return {"files": told.count(), "changed": changed.count(), "removed": gone.count(), "buckets": len(touched), "embedded": embedded}

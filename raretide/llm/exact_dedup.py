"""Exact deduplication as a stateful stream.

Files arrive as micro-batches; keyed state on disk (the RocksDB state store, without a watermark and so without
expiry) holds for each digest of a text the number of rows, the largest identifier and that row's content locator
(file and row index). Every hit is then checked on full bytes: the row's text is fetched by its own locator, the
keeper's by the one the state retained, and rows whose bytes differ in spite of equal digests form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raretide.llm.workspace import Workspace

#: State on disk. Without preallocation an instance costs what it holds, however many partitions the state has.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one group that share a salt when the keeper's text is sent to them.
ROWS_PER_SALT = 500


def _sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _located(df: DataFrame, id_col: str, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(text, F.lit(""))
    return df.select(F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("me"), digest(body).alias("digest"), body.alias("body"))


def _streamable(spark: SparkSession, path: str) -> str:
    """A file source wants a folder or a pattern: a single file is named by a pattern that only it matches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return f"{path[:-1]}[{path[-1]}]"
    return path


def _stream_state(spark: SparkSession, path: str, schema: T.StructType, id_col: str, text: Column, folder: str, trigger: dict[str, str], digest: Callable[[Column], Column]) -> DataFrame:
    """Run the stream over the files of path that folder's state has not met; return the last state of each digest."""
    out, before = f"{folder}/updates", {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = _located(spark.readStream.schema(schema).options(**trigger).parquet(_streamable(spark, path)), id_col, text, digest)
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("me").alias("keeper"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/stream")
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ident = T.StructType([T.StructField("id", schema[id_col].dataType), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    kind = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n", T.LongType()), T.StructField("keeper", ident)])
    try:
        updates = spark.read.schema(kind).option("basePath", out).parquet(out)
    except Exception as e:  # no file arrived, so no batch was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))  # both only grow


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, trigger: dict[str, str] | None = None, state: str | None = None, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalise(text)`` (default: the text itself) is identical; null counts as empty. The row
    with the largest identifier stays; rows that repeat an identifier are told apart by file and row index, so that
    exactly one row of a group is kept. A null identifier is the smallest. An empty table gives an empty result.
    Further columns, whatever their names, are not read. ``trigger``: file-source options that size a micro-batch.
    ``state``: a shared folder that keeps the keyed state, so that a later call over the grown table reads the state of
    all earlier files and only streams the new ones; by default it lives as long as the call. Files are never changed
    once they are there. ``digest`` names a text; unequal texts of one digest are told apart by their bytes.
    """
    source = spark.read.parquet(path)
    schema = T.StructType([source.schema[id_col], source.schema[text_col]])
    text = (normalise or (lambda c: c))(F.col(text_col))
    with Workspace(spark, "exact-dedup") as work:
        folder = state.rstrip("/") if state else work.path("state")
        state = work.table(_stream_state(spark, path, schema, id_col, text, folder, trigger or {"maxBytesPerTrigger": str(64 << 30)}, digest), "known")
        rows = _located(spark.read.schema(schema).parquet(path), id_col, text, digest)
        known = work.keep(rows.select("me", "digest").join(state, "digest"))
        odd = work.table(_differing(rows, known), "differing")
        if not odd.isEmpty():  # equal digests of different bytes: regroup those digests by the bytes themselves
            whole = rows.join(odd.select("digest").distinct(), "digest")
            groups = whole.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max("me").alias("keeper"))
            mended = whole.join(groups, ["digest", "body"]).select("digest", "me", "n", "keeper")
            known = work.keep(known.join(odd, "digest", "left_anti").select("digest", "me", "n", "keeper").unionByName(mended))
    return known.select(
        F.col("me.id").alias("doc_id"),
        F.col("keeper.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("me") == F.col("keeper")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _differing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Digests under which some row's bytes are not the keeper's. Hot groups are salted by their size."""
    hits = known.filter("n > 1")
    place = lambda c: [F.col(f"{c}.file").alias("file"), F.col(f"{c}.row").alias("row")]
    salts = (F.col("n") / ROWS_PER_SALT).cast("long") + 1
    texts = rows.select(*place("me"), "body")
    own = hits.select(*place("me"), "digest", F.pmod(F.xxhash64("me"), salts).alias("salt")).join(texts, ["file", "row"])
    keepers = hits.filter(F.col("me") == F.col("keeper")).select(*place("me"), "digest", salts.alias("salts")).join(texts, ["file", "row"])
    keepers = keepers.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("body").alias("kept_body"))
    return own.join(keepers, ["digest", "salt"]).filter("body <> kept_body").select("digest").distinct()

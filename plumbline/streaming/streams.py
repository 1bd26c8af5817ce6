"""Quality checks, reject splits, windowed metrics, de-duplication and merges on streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.columns import col
from plumbline.operators.checks import Settings, run_row_checks
from plumbline.operators.load import LoadRules, clean_values, merge_scd1, merge_scd2, one_per_key, tag_rejects, without_late
from plumbline.session import checkpoint


def _start(writer, checkpoint_path: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def validate_stream(stream: DataFrame, dataset: str, issues_path: str, checkpoint_path: str, settings: Settings = Settings(),
                    only: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """The batch checks on every micro-batch. A batch owns its folder, so a retry overwrites it."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        run_row_checks(batch, dataset, settings, only).write.mode("overwrite").parquet(f"{issues_path}/batch_id={batch_id}")

    return _start(stream.writeStream.foreachBatch(judge), checkpoint_path, once)


def tagged_stream(stream: DataFrame, rules: LoadRules) -> DataFrame:
    """Stateless: every row with the rules it breaks."""
    return tag_rejects(stream, rules)


def split_stream(stream: DataFrame, rules: LoadRules, good_path: str, reject_path: str, checkpoint_path: str, once: bool = True) -> tuple[StreamingQuery, StreamingQuery]:
    """Two file sinks, each with exactly-once output: accepted rows, and rejects as JSON with reasons."""
    tagged = tagged_stream(stream, rules)
    hard = F.exists("_reasons", lambda r: r.rejects)
    good = clean_values(tagged.filter(~hard).drop("_reasons"), rules)
    payload = F.to_json(F.struct(*[col(c) for c in stream.columns]))
    rejects = tagged.filter(F.size("_reasons") > 0).select(payload.alias("row_json"), F.explode("_reasons").alias("r")).select(
        "row_json", "r.reason", "r.column_name", "r.rejects")

    def sink(df, path, name):
        return _start(df.writeStream.format("parquet").option("path", path).outputMode("append"), f"{checkpoint_path}/{name}", once)

    return sink(good, good_path, "good"), sink(rejects, reject_path, "rejects")


def window_metrics(df: DataFrame, event_time: str, bad: dict[str, Column], width: str = "1 day", late: str | None = None) -> DataFrame:
    """Rows and bad-row rates per tumbling window; the same function serves a batch and a stream."""
    source = df.withColumn("_t", col(event_time).cast("timestamp"))
    if late is not None:
        source = source.withWatermark("_t", late)
    return source.groupBy(F.window("_t", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(p).alias(f"{k}_bad") for k, p in bad.items()]
    ).select(
        F.col("w.start").alias("window_start"), "n_rows", *[f"{k}_bad" for k in bad],
        *[F.round(F.col(f"{k}_bad") / F.col("n_rows"), 6).alias(f"{k}_rate") for k in bad])


def stream_window_metrics(stream: DataFrame, event_time: str, bad: dict[str, Column], path: str, checkpoint_path: str,
                          width: str = "1 day", late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Append a window once the watermark has passed it."""
    metrics = window_metrics(stream, event_time, bad, width, late)
    return _start(metrics.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint_path, once)


def window_signals(windows: DataFrame, rates: list[str], rate_change: float = 0.08, row_change: float = 0.15) -> DataFrame:
    """window_start, signal, metric, before, after of every window that differs too much from the one before it.

    ``windows`` has one row per closed window (see ``window_metrics``); windows without rows do not exist and are skipped.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("window_start")  # one row per window: as many as there are time units
    compared = windows.select("window_start", "n_rows", F.lag("n_rows").over(before).cast("double").alias("p_rows"), *[
        x for r in rates for x in (F.col(f"{r}_rate"), F.lag(f"{r}_rate").over(before).alias(f"p_{r}"))])
    rows = F.col("n_rows").cast("double")
    found = [F.when(F.abs(rows - F.col("p_rows")) > row_change * F.col("p_rows"), F.struct(
        F.lit("row_count_drift").alias("signal"), F.lit("n_rows").alias("metric"), F.col("p_rows").alias("before"), rows.alias("after")))]
    found += [F.when(F.abs(F.col(f"{r}_rate") - F.col(f"p_{r}")) > rate_change, F.struct(
        F.lit("rate_drift").alias("signal"), F.lit(r).alias("metric"), F.col(f"p_{r}").alias("before"), F.col(f"{r}_rate").alias("after"))) for r in rates]
    return compared.select("window_start", F.inline(F.array_compact(F.array(*found))))


def stream_window_drift(stream: DataFrame, event_time: str, bad: dict[str, Column], path: str, checkpoint_path: str, width: str = "1 day",
                        late: str = "1 day", once: bool = True, **limits) -> StreamingQuery:
    """Signals between each closed window and the one before it, once each; read them with ``read_window_drift``.

    A window closes when the watermark passes it, so rows that are late by less than ``late`` still count in it. The last
    closed window is the state: a batch starts from the one that the batch before it left, and both its signals and its
    state lie in folders of its own, so a batch that is run again writes the same.
    """
    metrics = window_metrics(stream, event_time, bad, width, late)

    def compare(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = None
        for earlier in range(batch_id - 1, -1, -1):  # the batch before, or one further back if that was lost with its folder
            try:
                last = spark.read.parquet(f"{path}/state/{earlier}")
                break
            except AnalysisException:
                continue
        closed = checkpoint(batch if last is None else batch.unionByName(last))
        signals = window_signals(closed, list(bad), **limits)
        if last is not None:
            seen = last.agg(F.max("window_start").alias("_seen"))  # null while no window has closed
            signals = signals.crossJoin(F.broadcast(seen)).filter("_seen IS NULL OR window_start > _seen").drop("_seen")
        signals.write.mode("overwrite").parquet(f"{path}/signals/{batch_id}")
        closed.orderBy(F.desc("window_start")).limit(1).write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    return _start(metrics.writeStream.foreachBatch(compare).outputMode("append"), checkpoint_path, once)


def read_window_drift(spark: SparkSession, path: str) -> DataFrame:
    """All signals so far."""
    return spark.read.parquet(f"{path}/signals/*")


def deduplicate_stream(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """First row per key; state is dropped when the watermark passes."""
    timed = stream.withColumn(event_time, col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def write_stream(stream: DataFrame, path: str, checkpoint_path: str, once: bool = True) -> StreamingQuery:
    return _start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint_path, once)


# --- merges -----------------------------------------------------------------------------------------

# A merged table is a folder with ``data/<version>.<revision>`` (Parquet, cut by bucket) and ``log/generation=<g>``. A log
# entry (version, revision, bucket, buckets) makes a bucket's rows current; later ones replace earlier ones. Batches add
# entries to the newest generation. A compaction writes all buckets anew and starts a generation with entries for all of
# them, in one small file: whoever sees it needs nothing older.

def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries of the newest generation of a merged table's log; None before the first commit."""
    try:
        log = spark.read.parquet(f"{path}/log")
    except AnalysisException:  # no folder, or one that holds only what a lost write left
        return None
    newest = log.agg(F.max("generation")).first()[0]
    return None if newest is None else log.filter(F.col("generation") == newest)


def _commit(spark: SparkSession, path: str, entries: list[tuple], generation: int) -> None:
    """Makes entries current: one file, so all or none of them count."""
    rows = spark.createDataFrame(entries, "version long, revision int, bucket int, buckets int")
    rows.withColumn("generation", F.lit(generation)).coalesce(1).write.mode("append").partitionBy("generation").parquet(f"{path}/log")


def _current(log: DataFrame) -> dict[int, tuple[int, int]]:
    """(version, revision) of each bucket; as many numbers as there are buckets."""
    latest = log.groupBy("bucket").agg(F.max(F.struct("version", "revision")).alias("at")).select("bucket", "at.version", "at.revision")
    return {r["bucket"]: (r["version"], r["revision"]) for r in latest.collect()}


def _bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("int")


def read_merged(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The current rows of a table written by ``merge_into_buckets``: of each bucket the last committed version."""
    log = _log(spark, path)
    if log is None:
        raise ValueError(f"no committed version in {path}")
    current: dict[tuple[int, int], list[int]] = {}
    every = _current(log)
    for bucket, at in every.items():
        if buckets is None or bucket in buckets:
            current.setdefault(at, []).append(bucket)
    part = lambda at: spark.read.parquet(f"{path}/data/{at[0]}.{at[1]}")
    parts = [part(at).filter(F.col("_bucket").isin(bs)) for at, bs in sorted(current.items())]
    if not parts:
        parts = [part(max(every.values())).limit(0)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("_bucket")


def live_versions(spark: SparkSession, path: str) -> int:
    """Number of scans that a read of the table is made of."""
    log = _log(spark, path)
    return 0 if log is None else len(set(_current(log).values()))


def merge_into_buckets(staged: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
                       batch_id: int, buckets: int = 64, compact_after: int | None = 16) -> None:
    """Merge a batch into a parquet table that is cut into buckets by a hash of the key; ``read_merged`` reads it.

    Only the buckets the batch touches are read. Their new state is a version of its own beside the old ones,
    and becomes current when the log names it, in one small file. A batch that is lost half-way leaves nothing
    that counts, and one that is replayed after its commit changes nothing. Batch ids must grow. The number of
    buckets is that of the first batch, or of the last compaction. Once the current rows lie in more than
    ``compact_after`` versions they are compacted.
    """
    spark = staged.sparkSession
    log = _log(spark, path)
    generation = 0
    if log is not None:
        state = log.agg(F.max("version").alias("version"), F.max("generation").alias("generation")).first()
        if batch_id <= state["version"]:
            return
        generation, buckets = state["generation"], log.orderBy(F.desc("version"), F.desc("revision")).first()["buckets"]
    bucket = _bucket_of(keys, buckets)
    touched = [r[0] for r in staged.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    target = None if log is None else read_merged(spark, path, touched)
    merged = merge(target, staged).withColumn("_bucket", bucket)
    merged.write.partitionBy("_bucket").mode("overwrite").parquet(f"{path}/data/{batch_id}.0")
    _commit(spark, path, [(batch_id, 0, b, buckets) for b in sorted(touched)], generation)
    if compact_after is not None and live_versions(spark, path) > compact_after:
        compact(spark, path, keys)


def compact(spark: SparkSession, path: str, keys: list[str], rows_per_bucket: int = 2_000_000) -> None:
    """Rewrites the current rows as one version, with twice as many buckets as long as they hold more rows than wanted.

    Doubling splits each bucket in two, so keys stay with their bucket or move to its new half. The new version counts
    from the moment its log file is there; lost before, the table is as it was, and the next compaction writes over what
    was left. Old versions stay readable until ``vacuum``.
    """
    log = _log(spark, path)
    if log is None:
        return
    rows = read_merged(spark, path)
    newest = log.orderBy(F.desc("version"), F.desc("revision")).first()
    buckets, n = newest["buckets"], rows.count()
    if not n:
        return
    while n > rows_per_bucket * buckets:
        buckets *= 2
    version, revision = newest["version"], newest["revision"] + 1
    target = f"{path}/data/{version}.{revision}"
    # one task a bucket would be idle or overloaded: tasks take what range partitioning gives them of several buckets
    rows.withColumn("_bucket", _bucket_of(keys, buckets)).repartitionByRange("_bucket", *[col(k) for k in keys]).write.partitionBy("_bucket").mode("overwrite").parquet(target)
    _commit(spark, path, [(version, revision, b, buckets) for b in range(buckets)], newest["generation"] + 1)


def vacuum(spark: SparkSession, path: str) -> int:
    """Frees the space of versions and log generations that no longer count; returns how many versions were emptied.

    Run it when nobody reads an older state: the data of a version that is not current are replaced by an empty file.
    """
    log = _log(spark, path)
    if log is None:
        return 0
    live = {f"{v}.{r}" for v, r in _current(log).values()}
    newest = log.first()["generation"]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/*").select(
        F.regexp_extract("path", r"/data/([0-9]+[.][0-9]+)/_bucket=", 1).alias("data"), F.regexp_extract("path", r"/log/generation=([0-9]+)/", 1).alias("generation")).distinct().collect()
    old = sorted({r["data"] for r in listed if r["data"]} - live)
    for name in old:
        spark.createDataFrame([], "emptied int").write.mode("overwrite").parquet(f"{path}/data/{name}")
    for g in {int(r["generation"]) for r in listed if r["generation"]} - {newest}:
        empty = spark.createDataFrame([], "version long, revision int, bucket int, buckets int")
        empty.write.mode("overwrite").parquet(f"{path}/log/generation={g}")
    return len(old)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint_path: str, latest_by: str | None = None,
                  scd: int = 1, as_of: Callable[[int], str] | None = None, buckets: int = 64, once: bool = True) -> StreamingQuery:
    """SCD type 1 or 2 merge of every micro-batch. ``as_of(batch_id)`` dates the type 2 change.

    With ``latest_by`` a late row, older than the stored row of its key, changes nothing.
    """
    from plumbline.operators.integrity import keep_latest
    from plumbline.operators.load import start_scd2

    def apply(batch: DataFrame, batch_id: int) -> None:
        staged = keep_latest(batch, keys, latest_by, [c for c in batch.columns if c not in (*keys, latest_by)]) if latest_by else one_per_key(batch, keys)

        def merge(target, new):
            if target is not None and latest_by:
                new = without_late(target, new, keys, latest_by)
            if scd == 1:
                return new if target is None else merge_scd1(target, new, keys)
            moment = as_of(batch_id)
            if target is None:
                return start_scd2(new, moment)
            return merge_scd2(target, new, keys, moment)

        merge_into_buckets(staged, path, keys, merge, batch_id, buckets)

    return _start(stream.writeStream.foreachBatch(apply), checkpoint_path, once)

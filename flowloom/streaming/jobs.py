"""Stream sources, sinks and the stream forms of registry, names, health and rates."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowloom.constants import UNKNOWN_MAC
from flowloom.operators import health, names
from flowloom.session import ROCKSDB, scratch_dir
from flowloom.streaming.ordered import asof, bounded_cache, with_event_time, with_silence


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with settings for stateful streams: as many state
    partitions as cores, and state that may outgrow memory."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def packet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 8, ip_only: bool = False, form: str = "parquet"
) -> DataFrame:
    """Packet records from files as they arrive; ``max_files`` per micro-batch is the rate limit.

    ip_only is the capture filter "ip": records without an IP layer are left out.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(form).load(folder)
    return rows.where(F.col("src_ip").isNotNull()) if ip_only else rows


def union_ifaces(streams: dict[str, DataFrame]) -> DataFrame:
    """One stream from several capture points, each tagged with its interface label."""
    tagged = [df.withColumn("iface", F.lit(label)) for label, df in streams.items()]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df)
    return merged


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; the result is a folder of parquet files."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, write, checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return query


def alert_log_sink(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Alert lines as text files, one folder per micro-batch. lines: one column ``line``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("line").write.mode("overwrite").text(f"{out}/batch_id={batch_id}")

    return run_batches(lines, write, checkpoint)


def _snapshots(spark: SparkSession, out: str) -> list[int]:
    """Batch ids of the finished snapshots below ``out``, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "batch_id=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _drop_snapshot(spark: SparkSession, out: str, batch_id: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch_id={batch_id}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_updates(df: DataFrame, out: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """A changing table: every micro-batch merges the rows that changed into the snapshot of the batch before.

    A snapshot is a folder named by its batch, published by its ``_SUCCESS`` file. Two are kept, as a batch that is
    repeated after a failure starts from the snapshot before it and writes the same again; older ones go. So the table's size
    follows its keys, not the time that the stream has run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = _snapshots(session, out)
        before = [b for b in known if b < batch_id]
        rows = batch
        if before:
            old = session.read.schema(batch.schema).parquet(f"{out}/batch_id={before[-1]}")
            on = [old[k].eqNullSafe(batch[k]) for k in key]
            rows = old.join(batch.select(*key), on, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        for b in before[:-1]:
            _drop_snapshot(session, out, b)

    return run_batches(df, write, checkpoint, "update")


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """The table as it stands: the newest finished snapshot."""
    found = _snapshots(spark, out)
    if not found:
        raise ValueError(f"no finished snapshot below {out}")
    return spark.read.parquet(f"{out}/batch_id={found[-1]}")


def new_devices(sightings: DataFrame) -> DataFrame:
    """One row at the first sight of an address; seen addresses stay in state on purpose."""
    return sightings.select("ip").dropDuplicates(["ip"])


def device_registry(sightings: DataFrame) -> DataFrame:
    """The running registry (one aggregation, as update mode asks for)."""
    real_mac = (F.length("mac") > 0) & (F.col("mac") != UNKNOWN_MAC)
    return sightings.groupBy("ip").agg(
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.max(F.when(real_mac, F.struct("ts_us", "mac")))["mac"], F.lit(UNKNOWN_MAC)).alias("mac"),
        F.coalesce(F.min(F.when(F.length("iface") > 0, F.struct("ts_us", "iface")))["iface"], F.lit("")).alias("iface"),
    )


def dns_cache(answers: DataFrame, services: Sequence[names.Service] = names.DEFAULT_SERVICES) -> DataFrame:
    """The running ip -> (service, qname) map."""
    rows = names.named_answers(answers, services).withColumnRenamed("answer_ip", "ip")
    last = F.max(F.struct("ts_us", "service", "qname"))
    return rows.groupBy("ip").agg(last.alias("_v")).select("ip", "_v.service", "_v.qname", "_v.ts_us")


def windowed(rows: DataFrame, seconds: int, delay: str, by: Iterable[str | Column] = (), **counts: Column) -> DataFrame:
    """Counts over fixed windows, emitted once the watermark has passed a window."""
    timed = with_event_time(rows, delay)
    grouped = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *by).agg(*[c.alias(n) for n, c in counts.items()])
    return grouped.withColumn("window_us", F.unix_micros("w.start")).drop("w")


def health_windows(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """frames: ts_us, is_arp, is_ip, is_tracked."""
    return windowed(
        frames,
        health.HEALTH_US // 1_000_000,
        delay,
        packets=F.count(F.lit(1)),
        arp=F.count_if("is_arp"),
        ip=F.count_if("is_ip"),
        reached_tracker=F.count_if("is_tracked"),
    )


def rate_alarm(packets: DataFrame, clock: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Packets per interface and 30 s window, and rows of 0 for the windows in which an interface was silent.

    ``clock`` is a stream of ``ts_us`` alone, for instance Spark's rate source. It makes time go on, so that timers find
    silence even when every interface falls silent at once. Packets are counted by a windowed aggregation; the keyed
    operator behind it sees one row per interface and window.
    """
    ticks = clock.select("ts_us", F.lit(None).cast("string").alias("iface"))
    timed = with_event_time(packets.select("ts_us", "iface").unionByName(ticks), delay)
    window = F.window("ts", f"{health.RATE_US // 1_000_000} seconds").alias("w")
    counts = timed.groupBy(window, "iface").agg(F.count(F.lit(1)).alias("packets"))
    return with_silence(counts, "iface", health.RATE_US)


def asof_dns_label(flows: DataFrame, answers: DataFrame, ip: str, delay: str, services: Sequence[names.Service] = names.DEFAULT_SERVICES) -> DataFrame:
    """Streams of flows (``ts_us`` is when they end) and of DNS answers -> flows with the service of ``ip`` at that time."""
    right = names.with_service(answers, services).withColumn("_named", names.is_named())
    right = right.select(F.col("answer_ip").alias(ip), "ts_us", "ans_id", "service", "_named")
    return asof(flows, right, ip, "ans_id", ["service"], delay, F.col("_named"))


class ProgressTotals(StreamingQueryListener):
    """Rows read, and dropped behind the watermark, over all micro-batches of the queries started while it listens.

    Spark keeps the progress of the last 100 micro-batches only; this keeps sums, however long a query runs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.open = spark, set()
        self.batches = self.rows_read = self.rows_late = 0
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.open.add(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self.changed:
            self.batches += 1
            self.rows_read += progress.numInputRows
            self.rows_late += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.open.discard(event.runId)
            self.changed.notify_all()

    def __enter__(self) -> ProgressTotals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self.changed:  # events come after a query has ended
            self.changed.wait_for(lambda: not self.open, timeout=60)
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        row = (self.batches, self.rows_read, self.rows_late)
        return self.spark.createDataFrame([row], "batches bigint, rows_read bigint, rows_late bigint")


def file_backlog(spark: SparkSession, source: str, checkpoint: str, suffix: str = ".parquet") -> DataFrame:
    """How far a stream over files lags: per micro-batch the files and bytes it took, and what waited after it.

    From the list of the source folder and the source's own log in the checkpoint. A file waits from the moment
    it was written; files written after a micro-batch had been planned do not count as waiting then.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(source)
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("written_ms"), "length")
    log = spark.read.option("recursiveFileLookup", True).schema("path string, timestamp long, batchId long").json(f"{checkpoint}/sources/0")
    taken = log.where("path IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("name"), "batchId").distinct()
    commits = spark.read.format("binaryFile").load(f"{checkpoint}/offsets").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.unix_millis("modificationTime").alias("planned_ms")
    )
    batches = commits.where(F.col("file").rlike("^[0-9]+$")).select(F.col("file").cast("bigint").alias("batch_id"), "planned_ms")
    held = files.join(taken, "name", "left").withColumn("batchId", F.coalesce("batchId", F.lit(2**62)))
    # micro-batches times files, by ranges of a few thousand rows each: counted per batch and summed up
    here = held.groupBy("batchId").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.min("written_ms").alias("written_ms"))
    later = here.select(F.col("batchId").alias("later"), F.col("files").alias("f"), F.col("bytes").alias("b"), F.col("written_ms").alias("w"))
    waits = batches.join(later, (F.col("later") > F.col("batch_id")) & (F.col("w") <= F.col("planned_ms")), "left")
    waits = waits.groupBy("batch_id").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("files_waiting"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_waiting"))
    took = here.select(F.col("batchId").alias("batch_id"), F.col("files").alias("files_taken"), F.col("bytes").alias("bytes_taken"))
    return waits.join(took, "batch_id", "left").na.fill(0).select("batch_id", "files_taken", "bytes_taken", "files_waiting", "bytes_waiting")


def new_folders(spark: SparkSession, *labels: str) -> list[str]:
    base = scratch_dir(spark, "stream")
    return [f"{base}/{label}" for label in labels]

"""Structured Streaming jobs: reindexing, rate limiting, progress, metrics."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.lineage import cut
from ..operators.delta import latest
from ..operators.fold import ordered_fold


def change_events(spark: SparkSession, path: str, schema: str = "source_id string, uri string, mime string, content string, at timestamp", **options) -> DataFrame:
    """Change events from files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def isolated(events: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], list[tuple[DataFrame, str]]]:
    """Chunks of the events that can be cut, and those that can't, each with its error.

    All events are cut at once; only where that fails are halves tried, down to the single event that fails. ``events``
    has at most one row for each source_id and uri.
    """
    key = ["source_id", "uri"]

    def tried(part: DataFrame, n: int, depth: int) -> tuple[list, list]:
        try:
            return [cut(chunker(part))], []
        except Exception as e:
            if n <= 1:
                return [], [(part, str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__)]
        side = F.pmod(F.xxhash64(*key, F.lit(depth)), F.lit(2))
        chunks, bad = [], []
        for half in (0, 1):
            some = part.where(side == half)
            if m := some.count():
                good, worse = tried(some, m, depth + 1)
                chunks += good
                bad += worse
        return chunks, bad

    n = events.count()
    return tried(events, n, 0) if n else ([], [])


def reindex_batch(df: DataFrame, n: int, chunker: Callable[[DataFrame], DataFrame], write: Callable[[str, DataFrame, int], None]) -> None:
    """One batch of ``reindex``."""
    own = latest(df, ["source_id", "uri"], F.desc("at"), F.desc("content")).persist()
    try:
        good = own.where("content is not null")
        parts, bad = isolated(good, chunker)
        dead = own.where("content is null").select("source_id", "uri", "at", F.lit("no content").alias("error"))
        for part, error in bad:
            dead = dead.unionByName(part.select("source_id", "uri", "at", F.lit(error).alias("error")))
        fine = good.join(dead.select("source_id", "uri"), ["source_id", "uri"], "left_anti") if bad else good
        chunks = None
        for part in parts:
            chunks = part if chunks is None else chunks.unionByName(part)
        if chunks is not None:
            write("upsert", chunks, n)
            key = [c for c in ("source_id", "uri") if c in chunks.columns]
            kept = chunks.groupBy(*key).agg(F.collect_set("chunk_id").alias("chunk_ids"))
            kept = fine.select("source_id", "uri").join(kept, key, "left")
            write("keep", kept.select("source_id", "uri", F.coalesce("chunk_ids", F.array().cast(kept.schema["chunk_ids"].dataType)).alias("chunk_ids")), n)
            write("manifest", fine.select("source_id", "uri", F.sha2("content", 256).alias("content_hash"), "at"), n)
        write("dead", dead, n)
    finally:
        own.unpersist()


def reindex(events: DataFrame, chunker: Callable[[DataFrame], DataFrame], write: Callable[[str, DataFrame, int], None], checkpoint: str, **trigger):
    """Starts the incremental reindexing of ``events``.

    A batch takes the latest event of each source_id and uri, cuts it, and writes in this order: ``upsert`` new
    chunks, ``keep`` (source_id, uri, chunk_ids: all others of the resource are to be pruned; none are kept of one that gave no
    chunks), ``manifest`` rows, ``dead`` (source_id, uri, at, error). An event that can't be cut is a dead letter, and so is one
    without content; the others go on. If a write fails, the batch fails before anything later is written, and is
    tried again with the same number after a restart. Where ``chunker`` passes no source_id on, uris are taken to be of one source.
    """
    return events.writeStream.foreachBatch(lambda df, n: reindex_batch(df, n, chunker, write)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bootstrap(events: Callable[[], DataFrame], chunker, write, checkpoint: str, **then):
    """Takes everything that is there in one run, waits for it, and then watches: ``events()`` is read with one checkpoint for both."""
    reindex(events(), chunker, write, checkpoint, availableNow=True).awaitTermination()
    return reindex(events(), chunker, write, checkpoint, **(then or {"processingTime": "10 seconds"}))


def admit(t: int, kept: deque, limit: int, window: int) -> bool:
    """Sliding-window limiter: times that lie ``window`` or more back go; rejected events are not counted."""
    while kept and kept[0] <= t - window:
        kept.popleft()
    if len(kept) < limit:
        kept.append(t)
        return True
    return False


def limiter(events: DataFrame, limit: int, window_s: int, late_s: int | None = None) -> DataFrame:
    """(subject, event_id, at, allowed) of a stream (subject, event_id, at).

    Events of one trigger are taken in time order. The state of a subject holds ``limit`` times at most. With ``late_s`` it goes once the
    subject has been idle by the clock for the window and ``late_s``, so events may be as late as that; without, it stays. A
    query with timeouts by the clock never runs out of batches: under availableNow, set spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        f = pd.concat(list(frames)).sort_values(["at", "event_id"])
        f["allowed"] = [admit(t, kept, limit, window_s * 1_000_000) for t in f["at"].astype("datetime64[us]").astype("int64").tolist()]
        state.update((list(kept),))
        if late_s is not None:
            state.setTimeoutDuration((window_s + late_s) * 1000)
        yield f[["subject", "event_id", "at", "allowed"]]

    return events.groupBy("subject").applyInPandasWithState(work, "subject long, event_id long, at timestamp, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout if late_s is None else GroupStateTimeout.ProcessingTimeTimeout)


def limiter_batch(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """(subject, event_id, allowed): the same over a table.

    After a pause as long as the window nothing is counted any more, so a subject may lie in several tasks, parted
    at its pauses. Those are found from the first and last event of each stretch of a window's length, a small table.
    """
    width = window_s * 1_000_000
    x = events.select("subject", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    x = x.withColumn("slot", F.floor(F.col("us") / width))
    ends = x.groupBy("subject", "slot").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    w = Window.partitionBy("subject").orderBy("slot")
    far = F.coalesce(F.col("low") - F.lag("high").over(w) >= width, F.lit(False)).cast("int")
    ends = ends.withColumn("far", far).select(F.col("subject").alias("s"), F.col("slot").alias("at"), F.sum("far").over(w).alias("part"))
    x = x.join(ends, x.subject.eqNullSafe(ends.s) & x.slot.eqNullSafe(ends["at"])).select("subject", "event_id", "us", "part")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return ordered_fold(
        x, ["subject"], ["us", "event_id"], deque, lambda kept, r: [(r[0], r[2], r[3] is not None and admit(r[3], kept, limit, width))],
        f"subject {kinds['subject']}, event_id {kinds['event_id']}, allowed boolean", ["subject", "part", "event_id", "us"], apart=["part"],
    )


def progress(events: DataFrame) -> DataFrame:
    """(run_id, phase, done, total, pct): works on a stream and on a table."""
    got = events.groupBy("run_id", "phase").agg(F.sum("done").alias("done"), F.max("total").alias("total"))
    return got.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"))).otherwise(0).cast("int"))


#: Names of the page metrics.
METRICS = ("CLS", "FCP", "FID", "INP", "LCP", "TTFB", "Next.js-hydration", "Next.js-route-change-to-render", "Next.js-render")


def clean_metrics(rows: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Stateless: known names, values of 0 to 600000, the route's path with a leading slash, 256 characters at most."""
    path = F.regexp_replace(F.regexp_replace("route", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    path = F.substring(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), 1, 256)
    return rows.where(F.col("name").isin(*names) & F.col("value").between(0, 600_000)).withColumn("route", path)


def latest_progress(events: DataFrame) -> DataFrame:
    """(job, state, ended): the last event of each job by seq, update mode on a stream."""
    return events.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.bool_or(F.col("state").isin("done", "failed")).alias("ended"))


def maintenance(points: DataFrame, manifest: DataFrame, now: Column, sweep: bool = True, stuck_minutes: int = 60):
    """(orphans or None, stuck rows to run again): one turn of the maintenance job."""
    from ..operators.delta import orphans, stuck

    return orphans(points, manifest, now) if sweep else None, stuck(manifest, now - F.expr(f"interval {stuck_minutes} minutes"))


def maintenance_turn(
    points: DataFrame, manifest: DataFrame, readable: DataFrame, contents: Callable[[DataFrame], DataFrame], chunker: Callable[[DataFrame], DataFrame], write: Callable[[str, DataFrame, int], None],
    now: Column, turn: int, sweep: bool = True, dry_run: bool = False, stuck_seconds: int = 600,
) -> DataFrame:
    """One turn of the maintenance job; the orphans it found (none without ``sweep``).

    Orphans go to ``write`` as orphans, unless ``dry_run``. Then the manifest rows that have been pending for ``stuck_seconds`` are indexed
    again, by the same path as changes: those of a source in ``readable`` (source_id) whose content ``contents`` gives (from
    source_id and uri: the same with mime and content). Sources that can't be read, and resources that give nothing, stay as they are for a later turn.
    Call it on a schedule, with ``turn`` as the number of the write.
    """
    from ..operators.delta import orphans, stuck

    found = orphans(points, manifest, now)
    found = cut(found if sweep else found.limit(0))
    if sweep and not dry_run and not found.isEmpty():
        write("orphans", found, turn)
    rows = stuck(manifest, now - F.expr(f"interval {stuck_seconds} seconds")).join(readable.select("source_id").distinct(), "source_id", "left_semi")
    again = cut(contents(rows.select("source_id", "uri").distinct()).where("content is not null").withColumn("at", now))
    if not again.isEmpty():
        reindex_batch(again, turn, chunker, write)
    return found

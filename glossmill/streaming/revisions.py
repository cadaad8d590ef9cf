"""A stream of document revisions: epoch and revision gates, exactly-once phases, cancellation, incremental work.

requests: seq, request_id, page_epoch, root_id, root_revision, phase (bootstrap | lexical), text, language_mode,
semantic_version, grammar_version, profile_revision, lexical_version, analysis_key. Outcomes are ok, stale,
duplicate, invalid and cancelled. gate() answers a batch with windows; stream_gate() keeps the same state per
root in Structured Streaming, where a row of phase cancel is a control row: it names a request of its root and epoch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import policy

KEY_PARTS = ["text", "language_mode", "semantic_version", "grammar_version", "profile_revision", "lexical_version"]
MOST_TEXT = 12_000
MOST_CODES = 1000  # distinct codes of integrity checks; they are a fixed list


def analysis_key() -> Column:
    parts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_PARTS))
    return F.concat(F.lit("ak1:"), F.sha2(F.to_json(parts), 256))


def is_valid() -> Column:
    fields = F.col("root_id").isNotNull() & (F.col("root_revision") >= 0) & (F.col("page_epoch") >= 0) & F.col("phase").isin("bootstrap", "lexical") & (F.char_length("text") <= MOST_TEXT)
    return F.coalesce(fields & (F.col("analysis_key") == analysis_key()), F.lit(False))


def gate(requests: DataFrame, cancelled: DataFrame | None = None, valid: Column | None = None) -> DataFrame:
    """requests with status, decided in order of seq inside each root.

    cancelled names requests by request_id, and by root_id and page_epoch where it has them, as the stream's control rows do.
    """
    rows = requests.withColumn("_valid", is_valid() if valid is None else valid)
    if cancelled is None:
        rows = rows.withColumn("_cancelled", F.lit(False))
    else:
        by = [c for c in ("request_id", "root_id", "page_epoch") if c in cancelled.columns]
        gone = cancelled.select(*by).distinct().withColumn("_gone", F.lit(True))
        rows = rows.join(gone, by, "left").withColumn("_cancelled", F.coalesce("_gone", F.lit(False))).drop("_gone")
    live = F.col("_valid") & ~F.col("_cancelled")
    past = lambda *by: Window.partitionBy("root_id", "_live", *by).orderBy("seq")
    rows = rows.withColumn("_live", live)
    rows = rows.withColumn("_epoch", F.max("page_epoch").over(past()))
    rows = rows.withColumn("_rev", F.max("root_revision").over(past("page_epoch")))
    rows = rows.withColumn("_old", (F.col("page_epoch") < F.col("_epoch")) | (F.col("root_revision") < F.col("_rev")))
    rows = rows.withColumn("_nth", F.row_number().over(past("page_epoch", "root_revision", "phase", "analysis_key")))
    done = F.max(F.col("phase") == "lexical").over(past("page_epoch", "root_revision").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_late", (F.col("phase") == "bootstrap") & F.coalesce(done, F.lit(False)))
    status = F.when(~F.col("_valid"), "invalid").when(F.col("_cancelled"), "cancelled").when(F.col("_old"), "stale").when(F.col("_nth") > 1, "duplicate").when(F.col("_late"), "stale").otherwise("ok")
    return rows.select(*requests.columns, status.alias("status"))


STATE = "epoch int, revision int, lexical boolean, seen array<string>, gone array<string>"


def decide(state: tuple, row) -> tuple[str, tuple]:
    """status of one live request and the root's next state (epoch, revision, lexical done, seen keys)."""
    epoch, revision, lexical, seen = state
    if row.page_epoch < epoch:
        return "stale", state
    if row.page_epoch > epoch:
        epoch, revision, lexical, seen = row.page_epoch, -1, False, ()
    if row.root_revision < revision:
        return "stale", (epoch, revision, lexical, seen)
    if row.root_revision > revision:
        revision, lexical, seen = row.root_revision, False, ()
    key = f"{row.phase}|{row.analysis_key}"
    if key in seen:
        return "duplicate", (epoch, revision, lexical, seen)
    late = row.phase == "bootstrap" and lexical
    return ("stale" if late else "ok"), (epoch, revision, lexical or row.phase == "lexical", (*seen, key))


def cancellations(gone: list[str], rows: pd.DataFrame, epoch: int) -> list[str]:
    """The requests cancelled so far and by the control rows, without those of epochs that are over."""
    rows = rows[(rows["phase"] == "cancel") & rows["request_id"].notna() & rows["page_epoch"].notna()]
    new = [f"{int(e)}|{r}" for e, r in zip(rows["page_epoch"], rows["request_id"])]
    return sorted(c for c in {*gone, *new} if int(c.split("|", 1)[0]) >= epoch)


def stream_gate(requests: DataFrame, valid: Column | None = None, keep_ms: int | None = None) -> DataFrame:
    """A streaming table seq, root_id, status; control rows get no answer.

    A micro-batch's rows of a root are taken in order of seq; across batches arrival decides. A control row reaches
    the requests of its own micro-batch, which are pending, and later ones of its epoch; one without request_id or
    epoch does nothing. State per root holds the keys of the newest revision and the cancelled requests of the newest
    epoch. With keep_ms it goes when the root has been silent for so long: a request that comes after that is taken as a
    root's first. Spark then makes batches without data to look for silent roots, so a query that shall end with its
    input (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled set to false.
    """
    rows = requests.withColumn("_valid", is_valid() if valid is None else valid)

    def advance(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        epoch, revision, lexical, seen, gone = tuple(state.get) if state.exists else (-1, -1, False, [], [])
        now = (epoch, revision, lexical, tuple(seen))
        pdf = pd.concat(list(batches)).sort_values("seq")
        gone = set(cancellations(gone, pdf, epoch))
        out = []
        for row in pdf[pdf["phase"] != "cancel"].itertuples():
            status = "invalid"
            if row.is_valid:
                status = "cancelled"
                if f"{int(row.page_epoch)}|{row.request_id}" not in gone:
                    status, now = decide(now, row)
            out.append((row.seq, key[0], status))
        kept = cancellations(sorted(gone), pdf.iloc[:0], now[0])
        state.update((now[0], now[1], now[2], list(now[3]), kept))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["seq", "root_id", "status"])

    own = rows.where("root_id is not null").select("seq", "request_id", F.col("root_id").cast("string").alias("root_id"), "page_epoch", "root_revision", "phase", "analysis_key", F.col("_valid").alias("is_valid"))
    return own.groupBy("root_id").applyInPandasWithState(advance, "seq long, root_id string, status string", STATE, "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


#: Keyed state of a root: the newest epoch and revision; what was done in that revision; requests cancelled in that epoch.
NEWEST = "page_epoch int, root_revision int, lexical boolean"
SEEN_KEY, SEEN = "phase string, analysis_key string", "seq long"
GONE_KEY, GONE = "page_epoch int, request_id string", "seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RootGate(StatefulProcessor):
    """The gate of one root, over keyed state of which a request touches its own entries only.

    keep_ms: how long a silent root is remembered (a timer clears it); gone_ms: how long a cancellation waits for its
    request (time to live of its entry). None: until the root's newer epochs or revisions replace them.
    """

    def __init__(self, keep_ms: int | None = None, gone_ms: int | None = None):
        self.keep_ms, self.gone_ms = keep_ms, gone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", NEWEST)
        self.seen = handle.getMapState("seen", SEEN_KEY, SEEN)
        self.gone = handle.getMapState("gone", GONE_KEY, GONE, self.gone_ms)

    def _advance(self, epoch: int, revision: int, now: tuple) -> tuple:
        """The root's next (epoch, revision, lexical); what an older epoch or revision left goes."""
        if epoch > now[0]:
            for key in [k for k, _ in self.gone.iterator() if k[0] < epoch]:
                self.gone.removeKey(key)
        if (epoch, revision) > now[:2]:
            self.seen.clear()
            return epoch, revision, False
        return now

    def _status(self, row, now: tuple) -> tuple[str, tuple]:
        epoch, revision = int(row.page_epoch), int(row.root_revision)
        if self.gone.containsKey((epoch, row.request_id)):
            return "cancelled", now
        if (epoch, revision) < now[:2]:
            return "stale", now
        now, key = self._advance(epoch, revision, now), (row.phase, row.analysis_key)
        if self.seen.containsKey(key):
            return "duplicate", now
        self.seen.updateValue(key, (int(row.seq),))
        late = row.phase == "bootstrap" and now[2]
        return ("stale" if late else "ok"), (*now[:2], now[2] or row.phase == "lexical")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("seq")
        now = before = tuple(self.newest.get()) if self.newest.exists() else (-1, -1, False)
        for row in pdf[(pdf["phase"] == "cancel") & pdf["request_id"].notna() & pdf["page_epoch"].notna()].itertuples():
            if row.page_epoch >= now[0]:
                self.gone.updateValue((int(row.page_epoch), row.request_id), (int(row.seq),))
        out = []
        for row in pdf[pdf["phase"] != "cancel"].itertuples():
            status = "invalid"
            if row.is_valid:
                status, now = self._status(row, now)
            out.append((row.seq, key[0], status))
        if now != before:
            self.newest.update(now)
        if self.keep_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame(out, columns=["seq", "root_id", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.newest, self.seen, self.gone):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_gate(requests: DataFrame, valid: Column | None = None, keep_ms: int | None = None, gone_ms: int | None = None) -> DataFrame:
    """A streaming table seq, root_id, status, as stream_gate(), over value and map state.

    A root's entries are read and written one by one, so a root with many requests or cancellations doesn't rewrite them all
    in each micro-batch. The session needs the RocksDB state store (ROCKS). A root's rows of one micro-batch are sorted in
    memory; maxFilesPerTrigger or maxOffsetsPerTrigger bound them.
    """
    rows = requests.withColumn("is_valid", is_valid() if valid is None else valid)
    own = rows.where("root_id is not null").select("seq", "request_id", F.col("root_id").cast("string").alias("root_id"), "page_epoch", "root_revision", "phase", "analysis_key", "is_valid")
    timed = keep_ms is not None or gone_ms is not None
    return own.groupBy("root_id").transformWithStateInPandas(RootGate(keep_ms, gone_ms), "seq long, root_id string, status string", "append", "ProcessingTime" if timed else "None")


def admit(items: DataFrame, most_items: int = 24, most_chars: int = 12_000, most_tokens: int = 600, most_buckets: int = 24) -> DataFrame:
    """request_id, admitted and sums of items(request_id, n_chars, n_tokens, buckets array)."""
    sums = items.groupBy("request_id").agg(F.count("*").alias("n_items"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    buckets = items.select("request_id", F.explode_outer("buckets").alias("b")).groupBy("request_id").agg(F.countDistinct("b").alias("n_buckets"))
    ok = (F.col("n_items") <= most_items) & (F.col("n_chars") <= most_chars) & (F.col("n_tokens") <= most_tokens) & (F.col("n_buckets") <= most_buckets)
    return sums.join(buckets, "request_id").withColumn("admitted", ok)


def new_work(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Accepted requests whose analysis_key has no stored result, one for each key."""
    fresh = requests.where("status = 'ok'").join(done.select("analysis_key").distinct(), "analysis_key", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("analysis_key").orderBy("seq"))).where("_n = 1").drop("_n")


PREFIX_DIGITS = 2  # hex digits of a key that name its partition of the result store: 256 partitions


def key_prefix() -> Column:
    """The first digits of an analysis key's hash, the partition that its result is stored in."""
    return F.substring(F.regexp_replace("analysis_key", "^ak1:", ""), 1, PREFIX_DIGITS)


def stored_keys(spark, path: str, batch: DataFrame, n: int) -> DataFrame:
    """analysis_key of the results under path that a batch may meet, written by other batches than n.

    Only partitions of the batch's own prefixes are read, which are told to the reader as a list (at most as many as there
    are prefixes); of them, files and row groups outside the batch's range of keys are left out by their statistics.
    """
    try:
        # The schema is told: without it a file would be opened to ask for it, and prefixes of digits be taken for numbers.
        results = spark.read.schema("analysis_key string, batch long, prefix string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return batch.select("analysis_key").limit(0)
    own = batch.where("status = 'ok'").select("analysis_key", key_prefix().alias("prefix"))
    asked = own.agg(F.collect_set("prefix").alias("prefixes"), F.min("analysis_key").alias("low"), F.max("analysis_key").alias("high")).first()
    if not asked["prefixes"]:
        return results.select("analysis_key").limit(0)
    kept = results.where(F.col("prefix").isin(sorted(asked["prefixes"])) & (F.col("batch") != n))
    return kept.where(F.col("analysis_key").between(asked["low"], asked["high"])).select("analysis_key")


def annotate_batches(gated: DataFrame, annotate, out_path: str, checkpoint: str):
    """A query that annotates each micro-batch's new keys once, under out_path by batch and prefix of the key.

    annotate keeps analysis_key. A batch that is run again after a failure replaces its own rows; of other batches' results
    only the keys in the partitions that the batch's own keys fall into are read.
    """

    def each(batch: DataFrame, n: int) -> None:
        fresh = X.settled(new_work(batch, stored_keys(batch.sparkSession, out_path, batch, n)))
        found = annotate(fresh).withColumn("prefix", key_prefix())
        found.repartition("prefix").sortWithinPartitions("prefix", "analysis_key").write.mode("overwrite").partitionBy("prefix").parquet(f"{out_path}/batch={n}")

    return gated.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def compact_results(spark, path: str, to: str, batch: int = -1) -> None:
    """Copies the results under path to one file for each prefix under to, as one batch that comes before all others.

    Each micro-batch leaves a file for each of its prefixes; a stream that is started anew on the copy reads few. Of keys
    that two batches hold the later batch's rows stay.
    """
    found = spark.read.parquet(path).schema
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'prefix' else f.dataType.simpleString()}" for f in found)
    results = spark.read.schema(kinds).parquet(path)
    last = results.groupBy("analysis_key").agg(F.max("batch").alias("batch"))
    kept = results.join(last, ["analysis_key", "batch"]).drop("batch")
    kept.repartition("prefix").sortWithinPartitions("prefix", "analysis_key").write.partitionBy("prefix").parquet(f"{to}/batch={batch}")


def coalesce_batches(changes: DataFrame, out_path: str, checkpoint: str):
    """A query that keeps of each micro-batch's changes(kind, path) the topmost paths of a kind, under out_path by batch.

    Paths name nodes from the root down, /body/div/p; rows without kind or path name none and go.
    """

    def each(batch: DataFrame, n: int) -> None:
        named = batch.where("kind is not null and path is not null")
        policy.topmost(named, "kind").write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def lexicon_for(verified: DataFrame, fallback: DataFrame, violations: DataFrame) -> tuple[DataFrame, str]:
    """The verified lexicon and 'ready', or the fallback and 'degraded' where integrity checks found anything."""
    return (fallback, "degraded") if violations.limit(1).count() else (verified, "ready")


def provider_status(violations: DataFrame) -> dict:
    """mode ('ready', or 'degraded' where integrity checks found anything) and failures, the distinct codes in order."""
    codes = sorted(r["code"] for r in violations.select("code").where("code is not null").distinct().limit(MOST_CODES).collect())
    return {"mode": "degraded" if codes else "ready", "failures": codes}

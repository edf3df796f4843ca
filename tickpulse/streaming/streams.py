"""Structured Streaming versions of the polling jobs (inventory 2.12).

The reference polls its tables on a schedule and anti-joins what it already processed.  Here the same work is a
stream over a folder of arriving files that a scheduled run takes up where the last one stopped:

* ``incremental_posts``  -- the post flow per micro-batch, one row per post key;
* ``sliding_tokens``     -- token counts over 24 h windows sliding every hour;
* ``tumbling_stock_sentiment`` -- per-ticker sentiment per 08:00-to-08:00 day.

Each takes the input folder and a state folder.  The state holds the checkpoint (which files were read) and a
``RunStore`` with what the batches came to, so a run in a new session reads new files only and returns the result over all files.

No watermark decides what counts: a backfill reads files in any order of event time.  Each micro-batch is reduced on
its own (partial counts, finished post rows); the result adds up the runs per key, a late row adds to its key whenever it
arrives, and no state grows in the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickpulse.constants import NEGATIVE, NEUTRAL, POSITIVE
from tickpulse.functions.timewin import epoch_seconds, ts_of_epoch
from tickpulse.tables.run_store import RunStore

HOUR = 3600
MAX_BYTES = 16 << 30  # per micro-batch; a scheduled run takes as many batches as it needs


def advance(
    spark: SparkSession,
    source: str,
    schema: StructType,
    state: str,
    fn: Callable[[DataFrame], DataFrame],
    combine: Callable[[DataFrame], DataFrame],
    sort: list[str],
    options: dict | None = None,
    fan: int = 8,
) -> DataFrame:
    """Read what is new in ``source``, keep ``fn`` of every micro-batch in the store, and return the store's rows."""
    store = RunStore(spark, f"{state}/runs", fn(spark.createDataFrame([], schema)).schema, sort, fan)

    def write_batch(batch: DataFrame, batch_id: int):
        store.put(batch_id, fn(batch))
        store.compact(combine)

    stream = spark.readStream.schema(schema).options(**(options or {"maxBytesPerTrigger": MAX_BYTES})).parquet(source)
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return combine(store.read())


def _summed(keys: list[str], counts: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts])


def incremental_posts(spark: SparkSession, source: str, schema: StructType, state: str, dictionary, scorer=None, options: dict | None = None) -> DataFrame:
    """st_incremental_posts: the post flow over arriving post files, equal to the batch flow on all of them.

    The store keeps one row per (timestamp, symbol, content) by the batch flow's own order, so the order in which files
    arrive does not matter and no text is kept as state.
    """
    from tickpulse.plans.flows import first_rows, process_posts

    return advance(spark, source, schema, state, lambda b: process_posts(b, dictionary, scorer=scorer), first_rows, ["timestamp", "symbol"], options)


def token_hours(spark: SparkSession, source: str, schema: StructType, state: str, ts_col: str, text_col: str, stopwords=None, options: dict | None = None) -> DataFrame:
    """``hour, token, n`` over arriving message files."""
    from tickpulse.functions.text import tokenize

    hour = epoch_seconds(ts_col) - F.pmod(epoch_seconds(ts_col), F.lit(HOUR))

    def count(batch: DataFrame) -> DataFrame:
        toks = batch.where(F.col(ts_col).isNotNull()).select(hour.alias("hour"), F.explode(tokenize(F.col(text_col), stopwords)).alias("token"))
        return toks.groupBy("hour", "token").agg(F.count(F.lit(1)).alias("n"))

    return advance(spark, source, schema, state, count, _summed(["hour", "token"], ["n"]), ["token", "hour"], options)


def sweep_windows(per_hour: DataFrame, window_hours: int) -> DataFrame:
    """``window_start, window_end, token, n`` of the windows that slide by the hour, from ``hour, token, n``.

    An event sweep: an hour's count enters with the first window that holds the hour and leaves after the last one, so two
    rows per (hour, token) are shuffled however long the window.  Between two events the running sum stands for every hour; only
    then is it laid out hour by hour.  A token has at most two events per hour of the calendar, whatever its number of rows.
    """
    edge = F.explode(F.array(F.struct((F.col("hour") - HOUR * (window_hours - 1)).alias("at"), F.col("n").alias("d")), F.struct((F.col("hour") + HOUR).alias("at"), (-F.col("n")).alias("d"))))
    events = per_hour.select("token", edge.alias("e")).select("token", "e.at", "e.d").groupBy("token", "at").agg(F.sum("d").alias("d"))
    line = Window.partitionBy("token").orderBy("at")
    swept = events.select("token", "at", F.sum("d").over(line).alias("n"), F.lead("at").over(line).alias("until")).where("n > 0")
    start = F.explode(F.sequence(F.col("at"), F.col("until") - HOUR, F.lit(HOUR).cast("long")))
    rows = swept.select(start.alias("start"), "token", "n")
    return rows.select(ts_of_epoch("start").alias("window_start"), ts_of_epoch(F.col("start") + HOUR * window_hours).alias("window_end"), "token", "n")


def sliding_tokens(
    spark: SparkSession, source: str, schema: StructType, state: str, ts_col: str, text_col: str, window_hours: int = 24, stopwords=None, options: dict | None = None
) -> DataFrame:
    """st_sliding_tokens: token counts per window of ``window_hours`` sliding by the hour (the hourly 24 h trending counts)."""
    return sweep_windows(token_hours(spark, source, schema, state, ts_col, text_col, stopwords, options), window_hours)


def tumbling_stock_sentiment(spark: SparkSession, source: str, schema: StructType, state: str, offset_hours: int = 8, options: dict | None = None) -> DataFrame:
    """st_tumbling_stock_sentiment: per-symbol sentiment counts per day running 08:00 to 08:00."""
    shift = offset_hours * HOUR
    day = F.col("timestamp") - F.pmod(F.col("timestamp") - shift, F.lit(86400))
    st = F.col("sentiment")
    names = ["positive", "negative", "neutral", "total"]

    def count(batch: DataFrame) -> DataFrame:
        return batch.where(F.col("timestamp").isNotNull() & F.col("symbol").isNotNull()).groupBy(day.alias("start"), "symbol").agg(
            F.count(F.when(st == POSITIVE, 1)).alias("positive"), F.count(F.when(st == NEGATIVE, 1)).alias("negative"),
            F.count(F.when(st == NEUTRAL, 1)).alias("neutral"), F.count(F.lit(1)).alias("total"))

    per = advance(spark, source, schema, state, count, _summed(["start", "symbol"], names), ["symbol", "start"], options)
    return per.select(ts_of_epoch("start").alias("window_start"), "symbol", *names)

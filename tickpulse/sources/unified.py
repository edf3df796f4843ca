"""Source scans of the reference schemas (inventory 2.1).

Each function is a projection + filter over a table DataFrame, so Catalyst
pushes the predicates and the column list into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickpulse.functions.text import strip, text_present
from tickpulse.functions.timewin import epoch_seconds, epoch_seconds_rounded, ntz, to_epoch, ts_of_epoch

POST_COLUMNS = ["platform", "post_id", "content", "timestamp"]


def src_facebook(fb_post: DataFrame) -> DataFrame:
    return fb_post.select(F.lit("facebook").alias("platform"), F.col("post_id").cast("string").alias("post_id"),
                          "content", F.col("timestamp").cast("bigint").alias("timestamp"))


def src_youtube(advice: DataFrame) -> DataFrame:
    return advice.select(F.lit("youtube").alias("platform"), F.col("source").alias("post_id"),
                         F.col("advise").alias("content"), F.col("timestamp").cast("bigint").alias("timestamp"))


def src_fireant(fireant: DataFrame) -> DataFrame:
    return fireant.select(F.lit("fireant").alias("platform"), F.col("post_id").cast("string").alias("post_id"),
                          F.col("original_content").alias("content"),
                          epoch_seconds_rounded("date").alias("timestamp"))


def src_zalo(zalo: DataFrame) -> DataFrame:
    return zalo.select(F.lit("zalo").alias("platform"), F.col("id").cast("string").alias("post_id"),
                       "content", F.col("date").cast("bigint").alias("timestamp"))


def unified_posts(fb_post, advice, fireant, zalo) -> DataFrame:
    """src_unified_posts: the four platform scans as one relation."""
    return (src_facebook(fb_post).unionByName(src_youtube(advice))
            .unionByName(src_fireant(fireant)).unionByName(src_zalo(zalo)))


def trending_union(fireant, fb_post, fb_reply, zalo, yt_post, since) -> DataFrame:
    """src_trending_union: (date, content) of five sources since ``since`` (UTC wall clock).

    The time predicates are written on the stored columns (epochs compared as
    numbers), so they reach the scans.
    """
    since_ep = to_epoch(since)
    since_ts = ntz(since)
    a = fireant.where(F.col("date") >= since_ts).select("date", F.col("original_content").alias("content"))
    b = fb_post.where(F.col("timestamp") >= since_ep).select(ts_of_epoch("timestamp").alias("date"), "content")
    posts = fb_post.where(F.col("timestamp") >= since_ep).select("post_id", "timestamp")
    c = fb_reply.join(posts, "post_id", "inner").select(ts_of_epoch("timestamp").alias("date"),
                                                        F.col("rely_content").alias("content"))
    d = zalo.where((F.col("date") >= since_ep) & F.col("content").isNotNull() & (F.col("content") != "NA")) \
        .select(ts_of_epoch("date").alias("date"), "content")
    e = yt_post.where((F.col("post_at") >= since_ts) & (F.col("post_content") != "")) \
        .select(F.col("post_at").alias("date"), F.col("post_content").alias("content"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def fireant_tagged(fireant: DataFrame, start, end, keep_untagged: bool = False) -> DataFrame:
    """fireant half of src_rumor_messages: posts in [start, end) with their tags joined by ', '.

    Tags are parsed inside the row (from_json) -- no explode/regroup shuffle.
    Posts without any tag vanish, as with a lateral join; ``keep_untagged`` keeps them without symbols (SURVEY Q21).
    """
    tags = F.from_json("tagged_symbols", "array<struct<symbol:string>>")
    syms = F.filter(F.transform(tags, lambda x: x["symbol"]), lambda s: s.isNotNull())
    rows = fireant.where((F.col("date") >= ntz(start))
                         & (F.col("date") < ntz(end)))
    if not keep_untagged:
        rows = rows.where(F.size(F.coalesce(tags, F.array())) > 0)
    return rows.select(
        F.col("post_id").cast("string").alias("id"),
        F.col("original_content").alias("content"),
        epoch_seconds_rounded("date").alias("date"),
        F.lit("fireant_posts").alias("source"),
        F.when(F.size(syms) > 0, F.array_join(F.array_sort(syms), ", ")).alias("symbols"),
    )


def concat_by_second(zalo: DataFrame, start_ts: int, end_ts: int, bucket: int = 1024) -> DataFrame:
    """concat_by_second: zalo messages of the same second -> MIN(id), contents joined by ' || '
    in id order.

    Two stages keep a hot second from landing in one task: contiguous id
    ranges are concatenated first, then the (few) range pieces per second.
    """
    rows = zalo.where((F.col("content") != "NA") & (F.col("date") >= start_ts) & (F.col("date") < end_ts)) \
        .select("id", "content", "date")
    piece = rows.groupBy("date", F.floor(F.col("id") / bucket).alias("b")).agg(
        F.min("id").alias("mid"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]),
                     " || ").alias("part"))
    whole = piece.groupBy("date").agg(
        F.min("mid").alias("id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mid", "part"))), lambda x: x["part"]),
                     " || ").alias("content"))
    return whole.select(F.col("id").cast("string").alias("id"), "content", F.col("date").cast("bigint").alias("date"),
                        F.lit("zalo_chat").alias("source"), F.lit("").alias("symbols"))


def rumor_messages(fireant, zalo, start, end, keep_untagged: bool = False) -> DataFrame:
    """src_rumor_messages: tagged fireant posts UNION ALL zalo chats concatenated per second."""
    return fireant_tagged(fireant, start, end, keep_untagged).unionByName(concat_by_second(zalo, to_epoch(start), to_epoch(end)))


def yt_window(yt_post: DataFrame, start, end) -> DataFrame:
    """src_yt_window: posts with post_at in [start, end)."""
    return yt_post.where((F.col("post_at") >= ntz(start))
                         & (F.col("post_at") < ntz(end)))


def ticker_dimension(df: DataFrame, col: str = "symbol") -> DataFrame:
    """src_tickers: non-empty, upper-cased, distinct symbols."""
    return df.where(F.col(col) != "").select(F.upper(F.col(col)).alias("symbol")).distinct()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """src_stopwords: one word per line, stripped, blank lines dropped (a set)."""
    lines = spark.read.text(path)
    return lines.select(strip("value").alias("word")).where("word <> ''").distinct()


LABELLED_SCHEMA = "text string, label string, stock_code string, has_stock boolean"


def read_labelled_jsonl(spark: SparkSession, path) -> DataFrame:
    """src_labelled_jsonl: JSON lines with defaults text='' label='neutral' stock_code='' has_stock=false."""
    raw = spark.read.schema(LABELLED_SCHEMA + ", _corrupt_record string") \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("label", F.lit("neutral")).alias("label"),
        F.coalesce("stock_code", F.lit("")).alias("stock_code"),
        F.coalesce("has_stock", F.lit(False)).alias("has_stock"),
    )


def numbered_lines(spark: SparkSession, path, parse=None) -> DataFrame:
    """The lines of one or more text files with ``line_no`` as ``cat`` would number them: files by path, lines as they stand.

    The place of a line is known from file metadata: its file, the start of its split, its turn in that split.  The
    splits' row counts, one row per split, make the numbers gapless; nothing is sorted by content and no file passes through
    one task.  ``parse`` may turn ``value`` into columns and drop lines (the three place columns must stay); the others are
    numbered then.
    """
    from pyspark.sql import Window

    from tickpulse.session import scratch_path

    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    lines = spark.read.text(path).select("value", *place)
    staged = scratch_path(spark, "lines")  # read for the counts and for the rows
    (parse(lines) if parse else lines).write.parquet(staged)
    rows = spark.read.parquet(staged)
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1  # a split is bounded
    out = rows.withColumn("_turn", turn).join(splits, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return out.withColumn("line_no", F.col("_before") + F.col("_turn")).drop("_file", "_block", "_at", "_turn", "_f", "_b", "_before")


def read_pairs_jsonl(spark: SparkSession, path, numbered: bool = False, extra: str = "") -> DataFrame:
    """src_pairs_jsonl: (original, rewritten) JSON lines; malformed lines and rows missing a field
    are skipped; the rewritten text may be named 'rewriter' or 'rewritten'.

    ``numbered`` adds ``line_no``, the pairs' turn in the files from 0; ``extra`` names further fields to keep, as a schema.
    """
    schema = "original string, rewriter string, rewritten string" + (f", {extra}" if extra else "")
    more = [c.split()[0] for c in extra.split(",")] if extra else []

    def parse(lines: DataFrame) -> DataFrame:
        place = [c for c in lines.columns if c != "value"]
        parsed = lines.select(F.from_json("value", schema).alias("j"), *place)
        out = parsed.select(*[F.col(f"j.{c}").alias(c) for c in more], F.col("j.original").alias("original"),
                            F.coalesce(F.col("j.rewritten"), F.col("j.rewriter")).alias("rewritten"), *place)
        return out.where(F.col("original").isNotNull() & F.col("rewritten").isNotNull()
                         & (F.col("original") != "") & (F.col("rewritten") != ""))

    return numbered_lines(spark, path, parse) if numbered else parse(spark.read.text(path))


def read_multi_jsonl(spark: SparkSession, paths: list[str], schema: str = LABELLED_SCHEMA) -> DataFrame:
    """src_multi_jsonl: concatenate the existing files; error if none exists."""
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    existing = []
    for p in paths:
        path = jvm_fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            existing.append(p)
    if not existing:
        raise ValueError("no valid dataset found")
    return spark.read.schema(schema).json(existing)


def present_text(df: DataFrame, col: str) -> DataFrame:
    """flt_text_present."""
    return df.where(text_present(col))


def posts_since(df: DataFrame, now_epoch: int, seconds: int = 86400) -> DataFrame:
    """flt_last_24h: timestamp >= now - 24h (no upper bound)."""
    return df.where(F.col("timestamp") >= F.lit(now_epoch - seconds))


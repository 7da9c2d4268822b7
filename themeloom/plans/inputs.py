"""Inputs of the registered queries, derived from the test tables in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


WIDE_TABLES = ("documents", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table. One that comes in fewer files than there are cores is dealt out first, so
    that work on long texts does not run in one task; a table of many files is left alone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE_TABLES and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    # The event times carry no zone; the session runs in UTC.
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


# --- texts and embeddings --------------------------------------------------------------------

TEXTS = """texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title_clean,
         nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS abstract_clean
  FROM documents)"""


def texts(spark, folder) -> DataFrame:
    """Title = first line, abstract = the rest; one-line documents have no abstract."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.substr(F.col("text"), F.length(title) + 2)
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        title.alias("title_clean"),
        F.nullif(rest, F.lit("")).alias("abstract_clean"),
    )


VECTORS = """vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"""


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


CORPUS = """corpus AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, embedding, 'b0' AS batch FROM embeddings
  UNION ALL
  SELECT CAST(e.vec_id AS VARCHAR), e.embedding, 'b1' FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id)"""


def corpus(spark, folder) -> DataFrame:
    """Embeddings in which every work that has a label occurs twice, in different batches."""
    e = table(spark, folder, "embeddings")
    again = e.join(table(spark, folder, "labels"), e.vec_id == F.col("doc_id"))

    def rows(df, batch):
        return df.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit(batch).alias("batch"))

    return rows(e, "b0").unionByName(rows(again, "b1"))


PRIMARY = """primary_variant AS (
  SELECT v.id, v.embedding FROM vectors v JOIN texts t USING (id) WHERE t.abstract_clean IS NOT NULL)"""


def primary(spark, folder) -> DataFrame:
    """Works with an abstract; the fallback variant is all works."""
    has_abstract = texts(spark, folder).filter("abstract_clean IS NOT NULL").select("id")
    return vectors(spark, folder).join(has_abstract, "id").select("id", "embedding")


CONCEPTS = """concepts AS (
  SELECT CAST(min(vec_id) AS VARCHAR) AS id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS embedding
  FROM embeddings GROUP BY label)"""


def concepts(spark, folder) -> DataFrame:
    """The first embedding of each label."""
    return table(spark, folder, "embeddings").groupBy("label").agg(
        F.min("vec_id").cast("string").alias("id"), F.min_by("embedding", "vec_id").alias("embedding")
    ).select("id", "embedding")


PLANTED = """planted AS (
  SELECT e.vec_id AS id, e.label,
         list_transform(list_zip(CAST(c.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])),
                        lambda p: p[1] * 0.9 + p[2] * 0.3) AS embedding
  FROM embeddings e
  JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) c USING (label))"""


def planted(spark, folder) -> DataFrame:
    """Embeddings drawn towards the first one of their label, so that labels form clusters."""
    e = table(spark, folder, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    moved = F.zip_with(
        F.col("c").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda a, b: a * 0.9 + b * 0.3
    )
    return e.join(first, "label").select(F.col("vec_id").alias("id"), "label", moved.alias("embedding"))


# --- topic assignments -----------------------------------------------------------------------

ASSIGNED = """assigned AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS BIGINT) AS topic_id
  FROM embeddings)"""


def assigned(spark, folder) -> DataFrame:
    """Labels as topics; label 9 plays the noise topic."""
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long")
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), topic.alias("topic_id"))


TOPICS = """topics AS (
  SELECT id, topic_id, 'embedding' AS topic_source, CAST(NULL AS DOUBLE) AS probability, 'corpus' AS source
  FROM assigned
  UNION ALL
  SELECT a.id, a.topic_id, 'projected', 1.0, 'keypaper' FROM assigned a
  JOIN labels l ON CAST(l.doc_id AS VARCHAR) = a.id WHERE l.quality = 1
  UNION ALL
  SELECT a.id, a.topic_id, 'fallback', 0.5, 'corpus' FROM assigned a
  JOIN texts t USING (id) WHERE t.abstract_clean IS NULL)"""


def topic_parts(spark, folder) -> list[DataFrame]:
    """Corpus rows, reference rows (works labelled good) and fallback rows (no abstract)."""
    base = assigned(spark, folder)
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    plain = texts(spark, folder).filter("abstract_clean IS NULL").select("id")

    def rows(df, topic_source, probability, source):
        return df.select(
            "id", "topic_id", F.lit(topic_source).alias("topic_source"),
            F.lit(probability).cast("double").alias("probability"), F.lit(source).alias("source"),
        )

    return [
        rows(base, "embedding", None, "corpus"),
        rows(base.join(good, "id"), "projected", 1.0, "keypaper"),
        rows(base.join(plain, "id"), "fallback", 0.5, "corpus"),
    ]


# --- counters and logs -----------------------------------------------------------------------

TICK_SEC = 21_600  # six-hour passes

SAMPLES = f"""ticks AS (
  SELECT CAST(user_id AS VARCHAR) AS host,
         make_timestamp((epoch_us(ts) // {TICK_SEC * 1000000} + 1) * {TICK_SEC * 1000000}) AS ts,
         count(*) AS n, arg_max(event_type, event_id) AS last_type
  FROM events GROUP BY 1, 2),
samples AS (
  SELECT host, ts,
         CASE WHEN last_type <> 'error' THEN
           CAST(sum(n) OVER (PARTITION BY host, date_trunc('week', ts) ORDER BY ts) AS DOUBLE) END AS count
  FROM ticks)"""


def samples(spark, folder) -> DataFrame:
    """Per user and six hours, the events so far this week: a counter that restarts weekly and
    cannot be read when the latest event is an error."""
    from pyspark.sql import Window

    width = TICK_SEC * 1_000_000
    tick = F.timestamp_micros((F.floor(F.unix_micros("ts") / width) + 1) * width)
    ticks = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("host"), tick.alias("ts")).agg(
        F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last_type")
    )
    # A week of passes is 28 rows at most, so the window is small whatever the traffic.
    week = Window.partitionBy("host", F.date_trunc("week", "ts")).orderBy("ts")
    count = F.when(F.col("last_type") != "error", F.sum("n").over(week).cast("double"))
    return ticks.select("host", "ts", count.alias("count"))


SCRAPES = """scrapes AS (
  SELECT 'pod' || user_id AS host, date_trunc('day', ts) AS ts,
         unnest(['te_request_count{method="' || event_type || '"} ' || CAST(event_id AS VARCHAR),
                 'te_request_count_sum ' || CAST(event_id AS VARCHAR),
                 'te_request_count_bucket{le="1"} 12',
                 '# HELP te_request_count requests']) AS line
  FROM events)"""


def scrapes(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    n = F.col("event_id").cast("string")
    lines = F.array(
        F.concat(F.lit('te_request_count{method="'), "event_type", F.lit('"} '), n),
        F.concat(F.lit("te_request_count_sum "), n),
        F.lit('te_request_count_bucket{le="1"} 12'),
        F.lit("# HELP te_request_count requests"),
    )
    return e.select(
        F.concat(F.lit("pod"), F.col("user_id").cast("string")).alias("host"),
        F.date_trunc("day", "ts").alias("ts"), F.explode(lines).alias("line"),
    )


LOG = """log AS (
  SELECT 'user_' || user_id || '.log' AS file, event_id * 3 + pos AS line_no, lines[pos + 1] AS line
  FROM (SELECT user_id, event_id, unnest([0, 1, 2]) AS pos,
    ['--- ' || strftime(ts, '%H:%M:%S') || ' ---',
     CASE WHEN event_type = 'error' THEN 'no python process running' ELSE
       '  etime=' || CASE WHEN s // 86400 > 0 THEN (s // 86400) || '-' ELSE '' END
       || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
       || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
       || ' cpu= ' || tenths // 10 || '.' || tenths % 10 || '%  pod_mem= ' || event_id % 100
       || '.5%  vsz=  80.2GB  rss=  ' || tenths // 10 || '.' || tenths % 10 || 'GB' END,
     CASE WHEN event_type = 'signup' THEN 'bad gpu line' ELSE (event_id % 100) || ' %, ' || tenths || ' MiB' END
    ] AS lines
    FROM (SELECT *, epoch_us(ts) // 1000000 % 2592000 AS s, CAST(floor(value * 10) AS BIGINT) AS tenths FROM events)))"""


def resource_log(spark, folder) -> DataFrame:
    """One log per user with three lines per event: a clock line, a process line and a GPU line."""
    s = F.unix_timestamp("ts") % 2_592_000
    tenths = F.floor(F.col("value") * 10)
    id100 = (F.col("event_id") % 100).cast("string")

    def two(x):
        return F.lpad(F.floor(x).cast("string"), 2, "0")

    whole = F.floor(tenths / 10).cast("string")
    amount = F.concat(whole, F.lit("."), (tenths % 10).cast("string"))
    days = F.floor(s / 86400)
    process = F.concat(
        F.lit("  etime="), F.when(days > 0, F.concat(days.cast("string"), F.lit("-"))).otherwise(""),
        two((s % 86400) / 3600), F.lit(":"), two((s % 3600) / 60), F.lit(":"), two(s % 60),
        F.lit(" cpu= "), amount, F.lit("%  pod_mem= "), id100,
        F.lit(".5%  vsz=  80.2GB  rss=  "), amount, F.lit("GB"),
    )
    gpu = F.concat(id100, F.lit(" %, "), tenths.cast("string"), F.lit(" MiB"))
    lines = F.array(
        F.concat(F.lit("--- "), F.date_format("ts", "HH:mm:ss"), F.lit(" ---")),
        F.when(F.col("event_type") == "error", "no python process running").otherwise(process),
        F.when(F.col("event_type") == "signup", "bad gpu line").otherwise(gpu),
    )
    e = table(spark, folder, "events").select("user_id", "event_id", F.posexplode(lines).alias("pos", "line"))
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".log")).alias("file"),
        (F.col("event_id") * 3 + F.col("pos")).alias("line_no"), "line",
    )

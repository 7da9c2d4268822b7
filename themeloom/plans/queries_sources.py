"""Queries of the readers and sinks: each writes files from the test tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions.vectors import as_double, unpack_embedding
from themeloom.lineage import Workspace
from themeloom.plans.inputs import SCRAPES, TEXTS, VECTORS, scrapes, table, texts, vectors
from themeloom.plans.queries_vectors import WIDTH
from themeloom.plans.registry import query
from themeloom.sources.logs import latest_file, read_metrics_text, read_resource_log
from themeloom.sources.stages import stage_cache, write_results
from themeloom.sources.variants import read_full_variant, read_text_only


def whole_variant(spark, folder, work):
    """Texts with their vectors, every work twice in two batches, as a variant folder."""
    rows = texts(spark, folder).join(vectors(spark, folder), "id")
    wide = unpack_embedding(rows.select("id", "title_clean", "abstract_clean", "embedding"), WIDTH)
    twice = wide.withColumn("batch", F.explode(F.array(F.lit("b0"), F.lit("b1"))))
    twice.write.partitionBy("batch").parquet(f"{work.root}/variant=title_abstract")


@query(
    "text_only_scan",
    "SELECT id, md5(title_clean) AS title, md5(abstract_clean) AS abstract FROM texts JOIN vectors USING (id)",
    (TEXTS, VECTORS),
)
def text_only_scan(spark, folder):
    work = Workspace(spark, "variant")
    whole_variant(spark, folder, work)
    back = read_text_only(spark, work.root, "title_abstract")
    return back.select(
        "id", F.md5(F.col("title_clean").cast("binary")).alias("title"), F.md5(F.col("abstract_clean").cast("binary")).alias("abstract")
    )


@query(
    "full_variant_scan",
    """SELECT id, md5(title_clean) AS title, length(abstract_clean) AS n_abstract, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total
    FROM texts JOIN vectors USING (id)""",
    (TEXTS, VECTORS),
)
def full_variant_scan(spark, folder):
    work = Workspace(spark, "variant")
    whole_variant(spark, folder, work)
    back = read_full_variant(spark, work.root, "title_abstract")
    total = F.aggregate(as_double(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return back.select(
        "id", F.md5(F.col("title_clean").cast("binary")).alias("title"), F.length("abstract_clean").cast("long").alias("n_abstract"),
        F.round(total, 5).alias("total"),
    )


@query(
    "metrics_files",
    """SELECT 'pool' || CAST(substr(host, 4) AS BIGINT) % 8 AS host, CAST(epoch(date_trunc('week', ts)) AS BIGINT) AS second, count(*) AS n_lines,
      CAST(sum(CASE WHEN line LIKE 'te_request_count{%' THEN CAST(regexp_extract(line, '([0-9]+)$', 1) AS BIGINT) END) AS BIGINT) AS total
    FROM scrapes GROUP BY ALL""",
    (SCRAPES,),
)
def metrics_files(spark, folder):
    """One scrape file for each of eight pools and each week, named after both."""
    work = Workspace(spark, "scrapes")
    pool = F.concat(F.lit("pool"), (F.substring("host", 4, 20).cast("long") % 8).cast("string"))
    lines = scrapes(spark, folder).withColumns({"host": pool, "second": F.unix_timestamp(F.date_trunc("week", "ts"))})
    lines.select("host", "second", "line").repartition("host", "second").write.partitionBy("host", "second").text(f"{work.root}/raw")
    rename(spark, f"{work.root}/raw", f"{work.root}/files")
    back = read_metrics_text(spark, f"{work.root}/files")
    value = F.when(F.col("line").startswith("te_request_count{"), F.regexp_extract("line", "([0-9]+)$", 1).cast("long"))
    return back.groupBy("host", F.unix_timestamp("ts").alias("second")).agg(
        F.count("*").alias("n_lines"), F.sum(value).alias("total")
    )


def rename(spark, raw: str, out: str) -> None:
    """Names each file after the partition that Spark wrote it to."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(raw)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(out))
    for host in fs.listStatus(root):
        if not host.isDirectory():
            continue
        for second in fs.listStatus(host.getPath()):
            parts = [f.getPath() for f in fs.listStatus(second.getPath()) if f.getPath().getName().startswith("part-")]
            name = f"{host.getPath().getName().partition('=')[2]}_{second.getPath().getName().partition('=')[2]}.prom"
            for part in parts:
                fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{out}/{name}"))


@query(
    "stage_cache",
    """SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, 'stored' AS origin FROM documents GROUP BY source, lang""",
)
def cached_stage(spark, folder):
    """The second call finds the stage stored and doesn't build it."""
    root = Workspace(spark, "stage").root
    docs = table(spark, folder, "documents")
    totals = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))

    def build(origin):
        return lambda: {"totals": totals.withColumn("origin", F.lit(origin))}

    stage_cache(spark, f"{root}/a", "totals", {}, ("totals",), build("stored"))
    return stage_cache(spark, f"{root}/a", "totals", {}, ("totals",), build("built again"))["totals"]


@query(
    "write_results",
    "SELECT vec_id AS id, label, 'c1' AS embedding_config, 'r1' AS bertopic_config, 'title' AS variant FROM embeddings",
)
def results(spark, folder):
    """The sink keeps the provenance inside the rows."""
    out = Workspace(spark, "results").root
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.lit("c1").alias("embedding_config"), F.lit("r1").alias("bertopic_config"),
        F.lit("title").alias("variant"),
    )
    written = write_results(out, "c1", "r1", "title", {"topics": rows})
    return spark.read.parquet(f"{written}/topics.parquet")


@query(
    "log_files",
    """SELECT lang, line_no, md5(line) AS line FROM (
      SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no, replace(replace(text, chr(10), ' '), chr(13), ' ') AS line
      FROM documents) WHERE line <> ''""",
)
def log_files(spark, folder):
    """One log of whole texts for each language, cut into files by ranges of documents and read back in splits; the newest
    file is found by its metadata."""
    work = Workspace(spark, "logs")
    docs = table(spark, folder, "documents")
    line = F.regexp_replace(F.regexp_replace("text", "\n", " "), "\r", " ")
    rows = docs.select("lang", "doc_id", line.alias("value")).repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    rows.select("lang", "value").write.partitionBy("lang").text(f"{work.root}/raw")
    back = read_resource_log(spark, f"{work.root}/raw/*", "lang=([^/]*)/")
    assert latest_file(spark, f"{work.root}/raw/*", "part-*") is not None
    lang = F.regexp_extract("file", "lang=([^/]*)/", 1)
    return back.filter("line <> ''").select(lang.alias("lang"), F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line"))

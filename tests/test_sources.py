import os
import time

import pytest
from pyspark.sql import functions as F

from themeloom.operators import monitor
from themeloom.plans import config
from themeloom.sources import logs, object_store, stages, variants

LOG = """--- 12:00:05 ---
  etime=01:05    cpu= 99.5%  pod_mem= 42.1%  vsz=  80.2GB  rss=  49.3GB
87 %, 20480 MiB
--- 12:00:10 ---
no python process running
0 %, 0 MiB
--- 12:00:15 ---
  etime=01:00:15 cpu=101.0%  pod_mem= 91.0%  vsz= 120.0GB  rss= 106.5GB
bad gpu line
"""

SCRAPE = """# HELP te_request_count requests
te_request_count{method="batch"} 41
te_request_count{method="single"} 7
te_request_count_sum 99.5
te_request_count_bucket{le="1"} 12
"""


@pytest.fixture()
def root(spark, tmp_path):
    rows = [("1", "t1", "a1", 1.0, 2.0, "x"), ("1", "t1", "a1", 1.0, 2.0, "y"), ("2", "t2", None, 3.0, 4.0, "x")]
    df = spark.createDataFrame(rows, "id string, title_clean string, abstract_clean string, V2 double, V1 double, chapter string")
    df.write.partitionBy("chapter").parquet(f"{tmp_path}/config=c/corpus/variant=v")
    return f"{tmp_path}/config=c/corpus"


def test_log_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of several splits, with empty lines, both line breaks and texts beyond ASCII."""
    texts = {
        "a.log": "\n".join(f"line {i} é" + "x" * (i % 37) for i in range(300)) + "\n", "b.log": "one\r\n\r\nthree\n\n\nsix",
        "c.log": "", "d.log": "y" * 5000 + "\n" + "z\n" * 50,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = set()
    for name, text in texts.items():
        lines = text.replace("\r\n", "\n").split("\n")
        want |= {(name, i, x) for i, x in enumerate(lines[:-1] if lines[-1] == "" else lines)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("512", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = logs.read_resource_log(spark, str(tmp_path)).collect()
            assert len(rows) == len(want) and {(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in rows} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_variant_readers(spark, root):
    assert "chapter" not in variants.read_variant(spark, root, "v").columns
    got = {r["id"]: r["embedding"] for r in variants.read_embeddings_only(spark, root, "v").collect()}
    assert got == {"1": [2.0, 1.0], "2": [4.0, 3.0]}
    assert variants.read_text_only(spark, root, "v").columns == ["id", "title_clean", "abstract_clean"]
    assert variants.read_full_variant(spark, root, "v").count() == 2


def test_scan_reads_no_text(spark, root):
    plan = variants.read_embeddings_only(spark, root, "v")._jdf.queryExecution().executedPlan().toString()
    assert "title_clean" not in plan


def test_reader_errors(spark, tmp_path):
    spark.createDataFrame([("1", "t")], "id string, title_clean string").write.parquet(f"{tmp_path}/variant=t")
    with pytest.raises(ValueError, match="no embedding columns"):
        variants.read_embeddings_only(spark, str(tmp_path), "t")
    spark.createDataFrame([], "id string, V1 double").write.parquet(f"{tmp_path}/variant=e")
    with pytest.raises(FileNotFoundError):
        variants.read_embeddings_only(spark, str(tmp_path), "e")


def test_metric_files(spark, tmp_path):
    (tmp_path / "pod1_1700000000.prom").write_text(SCRAPE)
    (tmp_path / "pod2_1700000000.prom").write_text("# nothing\n")
    got = monitor.sum_metric(logs.read_metrics_text(spark, str(tmp_path)), "te_request_count")
    assert {r["host"]: r["count"] for r in got.collect()} == {"pod1": 48.0, "pod2": None}


def test_resource_log_file(spark, tmp_path):
    (tmp_path / "pod_watch_1.log").write_text(LOG)
    rows = monitor.parse_resource_log(logs.read_resource_log(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [round(r["minutes"], 4) for r in rows] == [1.0833, 60.25]
    assert [r["gpu_gib"] for r in rows] == [20.0, None]
    assert [r["danger"] for r in rows] == [False, True]
    paired = monitor.pair_next_line(logs.read_resource_log(spark, str(tmp_path)))
    assert paired.filter(F.col("line").contains("etime=01:05")).first()["next_line"] == "87 %, 20480 MiB"


def test_newest_log(spark, tmp_path):
    for i, name in enumerate(["pod_watch_b.log", "pod_watch_a.log", "other.log"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (time.time() + i * 10, time.time() + i * 10))
    assert logs.latest_file(spark, str(tmp_path)).endswith("pod_watch_a.log")


def test_object_store_settings():
    assert object_store.object_store_conf(None) == {}
    conf = object_store.object_store_conf("host.example")
    assert conf["fs.s3a.path.style.access"] == "true" and conf["fs.s3a.attempts.maximum"] == "8"


def test_fingerprints():
    a = config.config_fingerprint({"primary_variant": "x"}, ("primary_variant", "umap_metric"))
    assert a == config.config_fingerprint({"primary_variant": "x", "umap_metric": None}, ("umap_metric", "primary_variant"))
    assert len(a) == 16 and a != config.config_fingerprint({"primary_variant": "y"}, ("primary_variant", "umap_metric"))
    assert a != config.config_fingerprint({"primary_variant": "x"}, ("primary_variant", "umap_metric"), "rows")


def test_options():
    base = {"primary_variant": "v", "hdbscan_min_cluster_size": 5, "hdbscan_min_samples": 2}
    assert config.resolve(base)["umap_n_neighbors"] == 15
    with pytest.raises(ValueError, match="unknown"):
        config.resolve({**base, "umap_neighbors": 3})
    with pytest.raises(ValueError, match="missing"):
        config.resolve({"primary_variant": "v"})
    assert config.config_name_of("/r/config=c/corpus", "/r/config=c/refs/") == "c"
    with pytest.raises(ValueError, match="one parent"):
        config.config_name_of("/r/config=c/corpus", "/r/config=d/refs")


def test_stage_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        got = stages.stage_cache(spark, f"{tmp_path}/s", "s", {"a": 1}, ("t",), build)
        assert got["t"].count() == 3
    assert calls == [1]


def test_data_fingerprint_ignores_order(spark):
    df = spark.range(100)
    assert stages.data_fingerprint(df) == stages.data_fingerprint(df.repartition(5))
    assert stages.data_fingerprint(df) != stages.data_fingerprint(spark.range(101))


def test_results_keep_their_provenance(spark, tmp_path):
    table = spark.range(1).withColumn("variant", F.lit("v"))
    folder = stages.write_results(str(tmp_path), "c", "r", "v", {"topics": table})
    assert spark.read.parquet(f"{folder}/topics.parquet").first()["variant"] == "v"


def test_numbers_go_on_from_file_to_file_of_a_log(spark, tmp_path):
    for name, lines in {"a/part-0": 3, "a/part-1": 2, "b/part-0": 1, "b/part-2": 4}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(lines)))
    rows = logs.read_resource_log(spark, f"{tmp_path}/*", "/([^/]*)/[^/]*$").collect()
    got = {r["line"]: r["line_no"] for r in rows}
    assert [got[x] for x in ("a/part-0 0", "a/part-0 2", "a/part-1 0", "a/part-1 1", "b/part-0 0", "b/part-2 0", "b/part-2 3")] == [0, 2, 3, 4, 0, 1, 4]
    assert {r["line_no"] for r in logs.read_resource_log(spark, f"{tmp_path}/*").filter("line LIKE '% 0'").collect()} == {0}

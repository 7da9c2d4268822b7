"""The whole pipeline against brute-force versions of its stages."""

import hashlib
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join
from themeloom.llm import line_dedup, queries

ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def planted(spark, folder, tmp_path_factory):
    """The smallest tables with a few documents of each kind that a stage must catch."""
    where = tmp_path_factory.mktemp("tables")
    docs = queries.table(spark, folder, "documents").collect()
    items = queries.table(spark, folder, "benchmark").collect()
    long = max((d["text"] for d in docs if len(d["text"]) < 3000), key=len)
    words = long.split(" ")
    near = " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 :]]).replace("\n", " ").replace(".", ",")
    far = long.replace("\n", " ").replace(".", ",")
    more = [
        (10_001, long), (10_002, "New words before. " + long), (10_003, far), (10_004, near), (10_005, items[0]["text"]),
        (10_006, None), (10_007, ""), (10_008, "tail. " * 4000), (10_009, items[1]["text"] + " plain"),
    ]
    rows = [tuple(d) for d in docs] + [(i, t, "en", "src1", len(t or "")) for i, t in more] + [(None, "no id here", None, None, None)]
    schema = queries.table(spark, folder, "documents").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, folder, name).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_run_equals_brute_force(spark, planted):
    keep = {(r["doc_id"], r["keep"]) for r in queries.op4_quality(spark, planted).collect()}
    table = queries.table(spark, planted, "documents").collect()
    rows = sorted(((d["doc_id"], d["text"]) for d in table if (d["doc_id"], True) in keep), key=lambda r: (r[0] is None, r[0] or 0))
    cut = test_line_dedup.brute(rows, line_dedup.BLOCK_WORDS)
    rows = [(i, new) for (i, old), new in zip(rows, cut) if new == old or new.strip(" ")]
    classes, _ = test_ngram_join.brute([(i if i is not None else -1, t) for i, t in rows])
    rows = [r for r, (i, first, size, _) in zip(rows, classes) if size == 1 or i == first]
    items = [tuple(r) for r in queries.table(spark, planted, "benchmark").select("item_id", "text").collect()]

    def clean(text):
        n, hit, _ = test_decontaminate.brute(text, items)
        return not (hit and 20 * hit >= n)

    rows = [(i, t) for i, t in rows if clean(t)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, planted).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {r[0] for r in got}
    assert 10_001 not in ids and 10_005 not in ids


def test_stages_keep_columns_and_rows_that_are_clean(spark, planted):
    docs = queries.table(spark, planted, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns, name
        none = stage(spark, docs.limit(0), planted)
        assert none.columns == docs.columns and none.count() == 0, name
    near = corpus_pipeline.near_copy_stage(spark, docs, planted)
    ids = {r["doc_id"] for r in near.select("doc_id").collect()}
    assert not ids & {10_001, 10_003, 10_004} and None in ids
    twice = corpus_pipeline.near_copy_stage(spark, docs.union(docs), planted)
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, near.collect()), key=str)
    cut = corpus_pipeline.line_stage(spark, docs, planted)
    assert cut.filter("n_chars <> length(text)").count() == 0
    assert 10_001 not in {r["doc_id"] for r in cut.select("doc_id").collect()}


def test_one_of_each_class_stays_whatever_the_ids(spark):
    a = " ".join(f"a{i}" for i in range(60))
    near, b = a + " more", " ".join(f"b{i}" for i in range(60))
    c, near_c = b.replace("b", "c"), b.replace("b", "c") + " more"
    rows = [(1, a), (2, near), (2, b), (3, b), (None, c), (None, near_c), (None, c), (4, None), (4, None), (5, "..."), (6, "..."), (None, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    docs = docs.selectExpr("*", "1 AS class_key", "2 AS text_hash", "3 AS _row_1", "4 AS h", "5 AS id", "6 AS size", "7 AS component")
    out = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len([t for i, t in got if i is None and t in (c, near_c)]) == 1
    rest = [r for r in got if r[0] is not None or r[1] not in (c, near_c)]
    assert sorted(rest, key=str) == sorted([(1, a), (2, b), (4, None), (5, "..."), (6, "..."), (None, "")], key=str)


def test_entry_without_the_operators(tmp_path):
    """The rest imports and registers its queries when this subpackage and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.returncode == 0, done.stderr

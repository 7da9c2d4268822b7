"""Connected components against a walk over the links."""

import random

from themeloom.lineage import Workspace
from themeloom.llm import components as cc


def walked(links):
    """(node, smallest node it reaches)."""
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in out:
                out[node] = start
                todo += near[node]
    return sorted(out.items())


def tangle(count=300, chain=120):
    rng = random.Random(5)
    name = [rng.randbytes(4) for _ in range(count)]
    links = [(rng.choice(name), rng.choice(name)) for _ in range(count // 2)]
    links += list(zip(name[:chain], name[1:chain]))  # a long chain of names in no order
    return links + links[:20] + [(name[0], name[0]), (None, name[1]), (name[2], None)]


def found(spark, links, work):
    rows = spark.createDataFrame(links, "x binary, y binary").repartition(6)
    return sorted((bytes(r["node"]), bytes(r["component"])) for r in cc.components(rows, "x", "y", work).collect())


def test_short_tables_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(cc, "_star", None)  # a round would fail
    links = tangle()
    assert found(spark, links, Workspace(spark, "test-components")) == walked(links)
    assert found(spark, [], Workspace(spark, "test-components")) == []


def test_rounds_join_the_slices(spark, monkeypatch):
    rounds, star = [], cc._star
    monkeypatch.setattr(cc, "_star", lambda *x: rounds.append(1) or star(*x))
    monkeypatch.setattr(cc, "SLICE", 3)  # on the driver: the second pass has a task for each file
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    links = tangle()
    try:
        assert found(spark, links, Workspace(spark, "test-components")) == walked(links)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rounds

import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import superminhash
from folioflow.llm.superminhash import components


def made(kind):
    rnd = random.Random(5)
    order = list(range(120))
    rnd.shuffle(order)
    if kind == "path":
        return list(zip(order, order[1:]))
    if kind == "sorted path":
        return [(i, i + 1) for i in range(119)]
    if kind == "hubs":
        return [(i, rnd.choice(order[:6])) for i in range(119) if i not in order[:6]] * 2
    if kind == "random":
        return [(a, b) for a, b in ((rnd.randrange(200), rnd.randrange(200)) for _ in range(110)) if a != b]
    return []


def least(edges):
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(label.items())


@pytest.mark.parametrize("kind", ["path", "sorted path", "hubs", "random", "none"])
def test_every_vertex_once_with_the_least_key(spark, kind):
    edges = made(kind)
    named = spark.createDataFrame(edges, "a int, b int").select(*(F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "UTF-8").alias(c) for c in "ab"))
    assert sorted((int(r.key), int(r.label)) for r in components(named).collect()) == least(edges)


def test_tables_written(spark, monkeypatch):
    """Stars of several leaders take one table: every table is a round of shuffles over all partitions."""
    written = []
    monkeypatch.setattr(superminhash, "keep", lambda df, real=superminhash.keep: written.append(1) or real(df))
    edges = made("hubs")
    components(spark.createDataFrame(edges, "a int, b int").select(*(F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "UTF-8").alias(c) for c in "ab")))
    assert len(written) == 1

"""Edit distances of whole batches: groups of like lengths, bands, single pairs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import similarity as S
from codecorpus.operators.partitioning import dealt_by_cost


def _cells(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def _pairs(n: int) -> list[tuple[str, str]]:
    r = random.Random(5)
    out = []
    for _ in range(n):
        letters = r.choice(["ab", "abcdef", "aé漢😀xyz"])
        x = "".join(r.choice(letters) for _ in range(r.randrange(r.choice([3, 70, 200]))))
        y = "".join(r.choice(letters) for _ in range(r.randrange(r.choice([3, 70, 300]))))
        cut = r.randrange(len(x) + 1)
        out.append((x, y if r.random() < 0.7 else x[:cut] + r.choice(["", "q", "zz" * 40]) + x[cut + 2:]))
    return out


@pytest.mark.parametrize("lanes", [(1, 4), (1, 64), (1, 100000), (1024, 5000)])
@pytest.mark.parametrize("band", [0.0, 0.1, 0.4, 1.0])
def test_batches_give_the_distance_of_the_recurrence(monkeypatch, lanes, band):
    monkeypatch.setattr(S, "LANES", lanes)
    monkeypatch.setattr(S, "BAND", band)
    pairs = _pairs(250)
    assert S.edit_distances(pairs) == [_cells(*p) for p in pairs]


def test_single_pairs_give_the_distance_of_the_recurrence():
    pairs = _pairs(250)
    assert [S.edit_distance_py(*p) for p in pairs] == [_cells(*p) for p in pairs]


def test_like_pairs_cost_less_together_than_one_by_one():
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    text = lambda: " ".join(r.choice(words) for _ in range(200))[:1000]
    pairs = [(text(), text()) for _ in range(300)]
    t0 = time.process_time()
    single = [S.edit_distance_py(*p) for p in pairs]
    t1 = time.process_time()
    assert S.edit_distances(pairs) == single
    assert time.process_time() - t1 < t1 - t0


def test_tasks_get_rows_that_are_alike(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).alias("size"), F.lit(1.0).alias("cost")).repartition(7)
    dealt = dealt_by_cost(rows.select("id", F.col("size").alias("s")), rows, "id", 8, alike=["size"])
    got = dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.count("id").alias("n"), F.collect_set("s").alias("s")).collect()
    assert sum(r["n"] for r in got) == 400 and len(got) == 8
    assert all(r["n"] <= 52 and max(r["s"]) - min(r["s"]) <= 3 for r in got)

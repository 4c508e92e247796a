"""R2 encode: common tokens get their ids where they are, only the others are sent to the vocabulary."""

from __future__ import annotations

import pyarrow as pa
import pytest

from codecorpus.operators import packing

ROWS = [("a", "x x y z x"), ("b", "z"), ("c", ""), ("d", None), (None, "x"), ("e", "y y q"), ("long", "w" * 70 + " x")]


def test_only_other_tokens_are_sent_on():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "n", "b"]), pa.array([["x", "r", "y", "x"], None, ["r"]])], ["k", "_t"])
    got = next(packing._common_ids(["x", "y"], [2, 3], "k")(iter([batch.slice(0)]))).to_pylist()
    assert got == [{"k": "a", "_ids": [2, 0, 3, 2], "_rest": [{"p": 1, "token": "r"}]}, {"k": "n", "_ids": [], "_rest": []},
                   {"k": "b", "_ids": [0], "_rest": [{"p": 0, "token": "r"}]}]


@pytest.mark.parametrize("common", [1, 2, 1 << 16])
def test_ids_do_not_depend_on_which_tokens_are_common(spark, monkeypatch, common):
    monkeypatch.setattr(packing, "COMMON", common)
    rows = spark.createDataFrame(ROWS, "k string, text string").repartition(3)
    vocab = packing.vocabulary(rows.selectExpr("split(text, ' ') tokens").selectExpr("filter(tokens, t -> t <> '') tokens"))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    want = {k: [ids[t] for t in (text or "").split()] if k else [] for k, text in ROWS}
    assert {r["k"]: r["input_ids"] for r in packing.encode(rows, "k", "text", vocab).collect()} == want
    # a token that the vocabulary does not hold has no id
    got = packing.encode(rows, "k", "text", vocab.where("token <> 'y'")).collect()
    assert {r["k"]: r["input_ids"] for r in got} == {k: [i for i in v if i != ids["y"]] for k, v in want.items()}

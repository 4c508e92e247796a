
from codecorpus.functions import arrays as A


def test_mask_pad_attention(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 2, 6), ([5], 3, 3)], "ids array<int>, n int, w int")
    r = df.select(A.mask_prompt("ids", "n").alias("l"), A.pad_right("ids", "w", 0).alias("r"),
                  A.pad_left("ids", "w", 0).alias("lp"), A.truncate("ids", 3).alias("t"),
                  A.non_pad_length(A.pad_right("ids", "w", 0)).alias("np"),
                  A.attention_mask(A.pad_right("ids", "w", 0)).alias("am")).collect()
    assert r[0]["l"] == [-100, -100, 7, 8] and r[1]["l"] == [-100]
    assert r[0]["r"] == [5, 6, 7, 8, 0, 0] and r[0]["lp"] == [0, 0, 5, 6, 7, 8]
    assert r[0]["t"] == [5, 6, 7] and r[0]["np"] == 4 and r[1]["am"] == [True, False, False]


def test_tokens(spark):
    df = spark.createDataFrame([("x=foo_1(é)<|EOT|>",)], "t string")
    assert df.select(A.tokens("t")).first()[0] == ["x", "=", "foo_1", "(", "é", ")", "<|EOT|>"]

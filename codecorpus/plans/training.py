"""Training-row queries (pipeline C): vocabulary, supervised rows with
masked labels and batch padding, splits, sharded order and packing.

Stand-ins: supervised pairs are (user turn, next assistant turn) of
``conversations``; pre-training rows are ``documents`` with ``lang`` as the
category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import render_prompt
from ..operators import metrics, ordering, packing
from ..operators.partitioning import spread
from ..session import ensure_checkpoint_dir
from ..sources.tables import table

MAX_LENGTH = 256
BATCH = 4
TOKEN_RE2 = A.TOKEN_PATTERN


def _ints(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), " ")


# ------------------------------------------------------------------ R2 vocabulary

def vocab(spark: SparkSession, d: str) -> DataFrame:
    """R2: vocabulary of all document tokens, ids by count desc then token."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return packing.vocabulary(docs.select(A.tokens(F.col("text")).alias("tokens")))


VOCAB_SQL = f"""WITH occ AS (SELECT unnest(regexp_extract_all(text, '{TOKEN_RE2}', 0)) AS token FROM documents)
SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS INTEGER) AS id
FROM occ GROUP BY token"""


# ------------------------------------------------------------------ R1, R3-R8

def sft_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"])


def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prompt + output + end marker encoded with the document-free
    vocabulary of the examples, truncated, prompt-masked, right-padded to
    the longest row of each batch of 4 (ids with pad 0, labels with -100),
    the left-padded form, and the attention count."""
    p = sft_pairs(spark, d)
    src = render_prompt(F.col("instruction"), strip=False)
    ex = p.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key"),
                  A.with_end_marker(src, F.col("output")).alias("example"),
                  F.size(A.tokens(src)).alias("n_src"))
    v = packing.vocabulary(ex.select(A.tokens(F.col("example")).alias("tokens")))
    enc = packing.encode(ex, "key", "example", v)
    ids = A.truncate(F.col("input_ids"), MAX_LENGTH)
    rows = enc.select("conv_id", "turn", ids.alias("ids"),
                      F.least(F.col("n_src"), F.lit(MAX_LENGTH)).alias("source_len"))
    rows = rows.withColumn("labels", A.mask_prompt(F.col("ids"), F.col("source_len")))
    order = ordering.with_row_index(rows.select("conv_id", "turn"), ["conv_id", "turn"], "pos")  # keys only, no arrays
    pos = rows.join(order, ["conv_id", "turn"]).withColumn("batch", ordering.batch_number("pos", BATCH))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    out = pos.withColumn("width", width)
    padded = A.pad_right(F.col("ids"), F.col("width"), A.PAD_ID)
    return out.select(
        "conv_id", "turn", "batch",
        _ints(padded).alias("input_ids"),
        _ints(A.pad_right(F.col("labels"), F.col("width"), A.IGNORE_INDEX)).alias("labels"),
        _ints(A.pad_left(F.col("ids"), F.col("width"), A.PAD_ID)).alias("left_ids"),
        _ints(A.pad_left(F.col("labels"), F.col("width"), A.IGNORE_INDEX)).alias("left_labels"),
        _ints(A.pad_right(F.col("ids"), F.lit(MAX_LENGTH), A.PAD_ID)).alias("fixed_ids"),
        F.size(F.filter(A.attention_mask(padded), lambda x: x)).alias("n_attend"),
        A.non_pad_length(padded).alias("n_tokens"))


SFT_ROWS_SQL = f"""WITH pairs AS (
  SELECT u.conv_id, u.turn,
         '# This is the assembly code:' || chr(10) || u.text || chr(10) || '# What is the source code?' || chr(10) AS source,
         a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
ex AS (SELECT conv_id, turn, source || output || chr(10) || '<|EOT|>' AS example,
              len(regexp_extract_all(source, '{TOKEN_RE2}', 0)) AS n_src FROM pairs),
occ AS (SELECT conv_id, turn, unnest(regexp_extract_all(example, '{TOKEN_RE2}', 0)) AS token,
               unnest(range(1, len(regexp_extract_all(example, '{TOKEN_RE2}', 0)) + 1)) AS p FROM ex),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM occ GROUP BY token),
enc AS (SELECT conv_id, turn, list(id ORDER BY p) AS full_ids FROM occ JOIN vocab USING (token) GROUP BY 1, 2),
r AS (SELECT conv_id, turn, full_ids[1:{MAX_LENGTH}] AS ids, least(n_src, {MAX_LENGTH}) AS source_len
      FROM enc JOIN ex USING (conv_id, turn)),
l AS (SELECT *, list_transform(range(least(source_len, len(ids))), lambda x: -100)
                || ids[least(source_len, len(ids)) + 1:] AS labels,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS batch FROM r),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM l)
SELECT conv_id, turn, batch,
  array_to_string(ids || list_transform(range(width - len(ids)), lambda x: 0), ' ') AS input_ids,
  array_to_string(labels || list_transform(range(width - len(labels)), lambda x: -100), ' ') AS labels,
  array_to_string(list_transform(range(width - len(ids)), lambda x: 0) || ids, ' ') AS left_ids,
  array_to_string(list_transform(range(width - len(labels)), lambda x: -100) || labels, ' ') AS left_labels,
  array_to_string(ids || list_transform(range({MAX_LENGTH} - len(ids)), lambda x: 0), ' ') AS fixed_ids,
  CAST(len(ids) AS INTEGER) AS n_attend, CAST(len(ids) AS INTEGER) AS n_tokens
FROM w"""


# ------------------------------------------------------------------ P12, P13, W3

def contiguous_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents in id order cut into 3 contiguous parts."""
    return ordering.contiguous_split(table(spark, d, "documents").select("doc_id"), ["doc_id"], 3)


CONTIGUOUS_SPLIT_SQL = """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CAST(least(floor((row_number() OVER (ORDER BY doc_id) - 1) / (SELECT n // 3 FROM n)), 2) AS INTEGER)
  AS part FROM documents"""


def percent_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents in id order into ceil(100/3)-percent bins."""
    return ordering.percent_split(table(spark, d, "documents").select("doc_id"), ["doc_id"], 3)


PERCENT_SPLIT_SQL = """WITH n AS (SELECT count(*) AS n FROM documents),
b AS (SELECT i AS bin, round_even(CAST(i * 34 AS DOUBLE) * (SELECT n FROM n) / 100.0, 0) AS lo FROM range(0, 3) t(i)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, CAST((SELECT max(bin) FROM b WHERE b.lo <= p.pos) AS INTEGER) AS bin FROM p"""


def _shard_key(id_col: str, seed: int, epoch: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))


def sharded(spark: SparkSession, d: str) -> DataFrame:
    """Seeded epoch order over 3 replicas, resumed at position 5."""
    docs = table(spark, d, "documents").select("doc_id")
    return ordering.sharded_order(docs, "doc_id", replicas=3, seed=42, epoch=1, start_index=5,
                                  order_key=_shard_key("doc_id", 42, 1))


SHARDED_SQL = """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42:1'), doc_id) - 1 AS p
                          FROM documents),
t AS (SELECT count(*) AS n, CAST(ceil(count(*) / 3.0) * 3 AS BIGINT) AS total FROM documents),
pp AS (SELECT doc_id, p FROM o UNION ALL SELECT doc_id, p + (SELECT n FROM t) FROM o WHERE p + (SELECT n FROM t) < (SELECT total FROM t))
SELECT doc_id, CAST(p % 3 AS INTEGER) AS rank, p // 3 - 5 AS local_pos FROM pp WHERE p // 3 - 5 >= 0"""


# ------------------------------------------------------------------ W1, W2, A12

def _windows(lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Binned documents with their token counts, and their windows."""
    binned = ordering.percent_split(lengths, ["doc_id"], 3)
    return binned, packing.pack(binned, "doc_id", "seq_length", WINDOW_TOKENS)


def _tokenised(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.select("doc_id", F.col("lang").alias("seq_category"), A.tokens(F.col("text")).alias("tokens"))


WINDOW_TOKENS = 2048


def packed(spark: SparkSession, d: str) -> DataFrame:
    """W1 + W2 + A12 (+ P13 bins): documents' token counts packed into
    windows of 2,048 tokens per bin; rows in, windows out, rate per bin."""
    binned, windows = _windows(_tokenised(spark, d).select("doc_id", "seq_category", F.size("tokens").alias("seq_length")))
    n_in = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_in"))
    n_out = windows.groupBy("bin").agg((F.max("window") + 1).alias("n_out"))
    return metrics.compression_rate(n_in, n_out, "bin")


def packed_rows(spark: SparkSession, d: str) -> DataFrame:
    """W2's rows: token ids of every window (R2 vocabulary of the documents),
    concatenated in W1 order, rows cut at the window size (R5)."""
    ensure_checkpoint_dir(spark)
    docs = _tokenised(spark, d).checkpoint()  # texts are tokenised once; lengths, vocabulary and ids read the saved rows
    _, windows = _windows(docs.select("doc_id", "seq_category", F.size("tokens").alias("seq_length")))
    vocabulary = packing.vocabulary(docs.select("tokens"))
    cut = docs.select("doc_id", F.slice("tokens", 1, WINDOW_TOKENS).alias("tokens"))
    ids = packing.encode(cut, "doc_id", "", vocabulary, tokens_col="tokens")
    rows = packing.packed_rows(windows, ids, "doc_id", WINDOW_TOKENS)
    return rows.select("bin", "window", F.size("input_ids").alias("n_tokens"), F.md5(_ints(F.col("input_ids"))).alias("ids"),
                       F.md5(_ints(F.col("labels"))).alias("labels"))


_PACK_WALK = f"""n AS (SELECT count(*) AS n FROM documents),
b AS (SELECT i AS bin, round_even(CAST(i * 34 AS DOUBLE) * (SELECT n FROM n) / 100.0, 0) AS lo FROM range(0, 3) t(i)),
p AS (SELECT doc_id, lang, len(regexp_extract_all(text, '{TOKEN_RE2}', 0)) AS len,
             row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
binned AS (SELECT doc_id, lang, len, CAST((SELECT max(bin) FROM b WHERE b.lo <= p.pos) AS INTEGER) AS bin FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY lang, len, doc_id) AS i,
             least(len, {WINDOW_TOKENS}) AS cut FROM binned),
walk(bin, doc_id, i, used, win) AS (
  SELECT bin, doc_id, i, cut, 0 FROM o WHERE i = 1
  UNION ALL
  SELECT o.bin, o.doc_id, o.i,
         CASE WHEN used > 0 AND used + cut > {WINDOW_TOKENS} THEN cut ELSE used + cut END,
         CASE WHEN used > 0 AND used + cut > {WINDOW_TOKENS} THEN win + 1 ELSE win END
  FROM walk w JOIN o ON o.bin = w.bin AND o.i = w.i + 1)"""

PACKED_SQL = f"""WITH RECURSIVE {_PACK_WALK}
SELECT bin, count(*) AS n_in, CAST(max(win) + 1 AS BIGINT) AS n_out, round((max(win) + 1) / count(*), 6) AS compression_rate
FROM walk GROUP BY bin"""

PACKED_ROWS_SQL = f"""WITH RECURSIVE {_PACK_WALK},
occ AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_RE2}', 0)) AS token,
               unnest(range(1, len(regexp_extract_all(text, '{TOKEN_RE2}', 0)) + 1)) AS p FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM occ GROUP BY token),
rows AS (SELECT bin, win, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY w.i, p) AS ids, count(*) AS n
         FROM occ JOIN vocab USING (token) JOIN walk w USING (doc_id) WHERE p <= {WINDOW_TOKENS} GROUP BY bin, win)
SELECT bin, CAST(win AS BIGINT) AS "window", CAST(n AS INTEGER) AS n_tokens, md5(ids) AS ids, md5(ids) AS labels FROM rows"""


QUERIES = {
    "r2_vocabulary": vocab,
    "r1_r8_sft_rows": sft_rows,
    "p12_contiguous_split": contiguous_split,
    "p13_percent_split": percent_split,
    "w3_sharded_order": sharded,
    "w2_a12_packing": packed,
    "w2_packed_rows": packed_rows,
}

ORACLE = {
    "r2_vocabulary": VOCAB_SQL,
    "r1_r8_sft_rows": SFT_ROWS_SQL,
    "p12_contiguous_split": CONTIGUOUS_SPLIT_SQL,
    "p13_percent_split": PERCENT_SPLIT_SQL,
    "w3_sharded_order": SHARDED_SQL,
    "w2_a12_packing": PACKED_SQL,
    "w2_packed_rows": PACKED_ROWS_SQL,
}

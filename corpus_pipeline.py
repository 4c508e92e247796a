"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all rows its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import cotraining, minhash, mixing, packing, toxicity
from codecorpus.llm.common import Scratch
from codecorpus.sources.tables import table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have (names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.7 or more go.

    Null and empty texts have no match and stay; repeated rows are scored
    each; an empty table stays empty; further columns are kept as they are,
    whatever their names."""
    score = _free(docs, "_toxicity")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, grammar, name=score).where(F.col(score) < 0.7).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose quality score is below 0.5 go.

    Null and empty texts, sources, languages and lengths are features like
    others; without labels of both kinds every document has the same score,
    the share of good labels (0.5 without any: all stay). Repeated rows are
    scored each; an empty table stays empty; further columns are kept."""
    score = _free(docs, "_quality")
    model = cotraining.learn(docs, table(spark, sf_dir, "labels"))
    return cotraining.quality(docs, model, name=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies the document with the
    smallest id stays.

    Null and empty texts have no copies and stay. Rows with the same id and
    text are one document: the one with the smallest other columns stays.
    Different texts under one id are different documents; they stay together
    if their id does. Rows without id are in no group; only repeated texts
    among them go. An empty table stays empty; further columns are kept."""
    found = minhash.near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = Scratch(spark, "kept").save(found, "ids")
    out = docs.join(kept.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    out = out.unionByName(docs.where("doc_id is null"))
    if kept.where("n > 1").isEmpty():
        return out
    same = [F.col("doc_id").alias("i"), F.sha2("text", 256).alias("h")]
    return out.groupBy(*same).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document as often as the mix takes it (0 to 3 times).

    Texts without words have size 0 and are taken as the mix takes their
    source; a null source is a source of its own; rows with the same id and
    source are taken alike. An empty table stays empty; further columns are
    kept, copies of a row are equal."""
    takes = mixing.mix(docs).where("copies > 0").select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), "copies").distinct()
    same = docs["doc_id"].eqNullSafe(takes["i"]) & docs["source"].eqNullSafe(takes["s"])
    times = F.explode(F.sequence(F.lit(1), takes["copies"].cast("int")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.join(takes, same).select(row, times.alias("time")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: best-fit packed pieces of at most 2048 tokens. Null and
    empty texts are one token; repeated rows are packed each; an empty table
    gives no pieces; further columns are left out."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: The classifiers, the sampling and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the
    shared folder and reread as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs

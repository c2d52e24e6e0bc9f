"""A training corpus from raw documents, stage by stage.

Each stage reads all that its predecessor kept.  Rows travel as one packed
column, so extra columns, also with the names of an operator's own, come
through unchanged.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from worksight.llm import decontaminate, minhash, mixing, quality, sharding, toxicity
from worksight.plans.materialize import scratch_dir

c = F.col


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *names)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, quality.fold(c("id"), 3) != 1)
    return toxicity.score(_packed(docs, "text"), model).where("score < 0.7").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, 80 %) one stays: that with the smallest id, then text hash, null ids last.
    Texts without words are no duplicates of others; of rows equal in id and text, one stays."""
    found = minhash.near_duplicates(docs).select(c("doc_id").alias("_id"), c("text_hash").alias("_mark"), "component_label")
    first = F.min(F.struct(c("_id").isNull(), "_id", "_mark"))
    kept = (found.where("component_label is not null").groupBy("component_label").agg(first.alias("at")).select("at._id", "at._mark")
            .union(found.where("component_label is null").select("_id", "_mark")).distinct())
    rows = _packed(docs, "doc_id", F.xxhash64("text").alias("mark"))
    joined = rows.join(kept, c("doc_id").eqNullSafe(c("_id")) & (c("mark") == c("_mark")), "left_semi")
    return joined.dropDuplicates(["doc_id", "mark"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    scanned = decontaminate.decontaminate(_packed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scanned.where("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that the sources' words meet their targets."""
    rows = _packed(docs, "doc_id", "source", mixing.word_count(c("text")).alias("size"))
    taken = mixing.mix(rows).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; a column with the name of an added one is replaced."""
    out = sharding.shard(_packed(docs, "doc_id", "text"), carry=["row"])
    added = [x for x in out.columns if x != "row"]
    return out.select(*[c("row")[x].alias(x) for x in docs.columns if x not in added], *added)


STAGES = [("toxicity", without_toxic), ("minhash_near_dedup", one_of_each_group),
          ("benchmark_decontamination", without_benchmark), ("source_mixing", mixed), ("sharding", sharded)]

#: SQL cannot express the trained score; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs

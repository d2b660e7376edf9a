"""From raw documents to a training mix, in five stages; each works on all that the one before kept.

The first four return the columns of ``documents``. The last repeats each document as often as the mix
takes it (copy_no counts the copies). Stages hold results that SQL can't express (a trained model,
signatures, keyed digests), so ORACLE_SQL is None; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, mixing, neardup, pii, quality
from quillspan.llm.scratch import Scratch


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under names that no operator uses, but for text: columns may be called anything."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Its labels are the ``labels`` table's."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names = _renamed(docs)
    return quality.score(plain, model, keep=tuple(names)).filter("predicted = 1").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, or one without an id where none has one.

    Of rows that share a doc_id, and of rows of equal text without one, the first by a digest of all columns counts.
    """
    kept = neardup.groups(docs).filter("node = component").select("node")
    plain, names = _renamed(docs)
    own = F.col(names[docs.columns.index("doc_id")])
    order = Window.partitionBy("node").orderBy(F.xxhash64(*[c for c, t in plain.dtypes if "map<" not in t and t != "variant"]))
    rows = plain.withColumn("node", neardup.node(own, F.col("text"))).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return rows.join(kept, "node", "left_semi").select(*names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    plain, names = _renamed(docs)
    found = decontaminate.contaminated(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(names))
    return found.filter("not contaminated").select(*names).toDF(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    out = pii.pseudonymise(docs, spark.conf.get("spark.quillspan.pii.key", "not a secret")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: 150 % of all words, weights 5, 2, 1 in turn, each source at most twice."""
    return mixing.repeated(docs, [5, 2, 1])


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs

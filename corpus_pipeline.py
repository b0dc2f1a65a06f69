"""From raw documents to token ids: five stages, each a table of its own.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard_join, language_id, mixing, token_file
from weftline.llm.common import Scratch, table
from weftline.llm.queries import byte_bpe
from weftline.session import ship_package

#: A text is rejected where no language is likelier than this, or where it has no letter.
MIN_SCORE = 0.4


def set_aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns that an operator would replace under other names."""
    return docs.withColumnsRenamed({c: f"__aside_{c}" for c in docs.columns if c.lower() in names})


def take_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    return rows.withColumnsRenamed({f"__aside_{c}": c for c in docs.columns}).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model learns from the labelled ones.

    A text that is null, empty or without a letter goes, and so does one whose best language has a score below MIN_SCORE, ties included.
    Repeated rows are judged alike. Without a label nothing is recognised; an empty table stays empty. Long texts are read whole.
    Columns named like the stage's own are set aside and come back.
    """
    model = language_id.learn(docs.select("text", "lang"))
    found = language_id.identify(set_aside(docs, "lang_pred", "score", "ambiguous"), model)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return take_back(kept.drop("lang_pred", "score", "ambiguous"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one text: that of the smallest id (a null id last), then of the smallest SHA-256. Of repeated rows, equal
    in id and text, one.

    A row is known by its id and its text's SHA-256, so rows of one id and different texts are judged apart. A null, empty or blank text is
    near to nothing and stays; an empty table stays empty; other columns, whatever their names, are those of a row that stays.
    """
    marked = docs.withColumn("__text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    groups = jaccard_join.jaccard_classes(marked.select("doc_id", "text", "__text"), ("__text",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text")).alias("k")
    of_groups = groups.filter(F.col("group").isNotNull()).groupBy("group").agg(first).select("k.doc_id", "k.__text")
    kept = of_groups.unionByName(groups.filter(F.col("group").isNull()).select("doc_id", "__text")).distinct()
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__of"))
    once = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__of")), "left_semi")
    return once.dropDuplicates(["doc_id", "__text"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A text without words, or a null one, has no passage and stays; repeated rows are judged alike, long texts whole. Items without words
    match nothing; an empty benchmark or table changes nothing. Columns named like the stage's own are set aside and come back.
    """
    found = decontaminate.decontaminate(set_aside(docs, "n_words", "n_hit", "items", "contaminated"), table(spark, sf_dir, "benchmark"))
    return take_back(found.filter("not contaminated").drop("n_words", "n_hit", "items", "contaminated"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, at most three times.

    A text without words has the size 0 and is not taken; a null source is one of the sources. Of equal rows as many are taken as fit; a long
    text is taken whole or not at all. An empty table gives an empty mix. Columns named like the stage's own are set aside and come back.
    """
    new = ("size", "source_size", "target", "repeats", "taken")
    mixed = mixing.mix(set_aside(docs, *new)).filter("repeats > 0")
    return take_back(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats")))).drop("__copy", *new), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's documents, read back: doc_id, start, n_tokens, ids_crc32.

    In the order of ids, a null one first; repeated rows are encoded each. A null or empty text is its end id alone; long texts are encoded whole;
    an empty table gives an empty file. Other columns are left.
    """
    path = Scratch(spark, "pipeline-tokens").path("ids")
    token_file.write_tokens(docs, path, byte_bpe())
    return token_file.read_tokens(spark, path)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: The stages learn, join and count beyond SQL. Tests hold every stage against brute force over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs

"""A corpus pipeline: language ID, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the next
one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import langid, mixing, packing, pii, simhash
from quantloom.llm.common import content, saved, unused
from quantloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known keep their rows, with the predicted language in ``lang``.

    The model learns from the labelled rows outside the held-out fold, as in op4. Rejected documents go: null, empty and letterless
    texts and those too far from every centroid. Repeated rows and null ids are kept; an empty table stays empty. The operator's
    columns take names that ``docs`` has not.
    """
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    prefix = "lang_"
    while any(unused(docs, prefix + c) != prefix + c for c in langid.NEW):
        prefix += "_"
    found = langid.identify(docs, model, prefix=prefix).where(~F.col(f"{prefix}rejected"))
    return found.withColumn("lang", F.col(f"{prefix}pred")).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least doc_id, a null id last; of several rows with one id and
    other contents the one with the least hash, of equal rows one.

    Null, empty and blank texts are copies of each other. All columns are kept as they are; an empty table stays empty.
    """
    one, two = unused(docs, "content_1"), unused(docs, "content_2")
    hashes = dict(zip((one, two), content(docs), strict=True))
    rows = docs.withColumns(hashes)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(one).alias("one"), F.col(two).alias("two"))
    found = simhash.near_duplicates(rows.select(order.alias("doc_id"), "text"))
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id.one").alias(one), F.col("id.two").alias(two)).distinct()
    # Equal rows are merged before they are shuffled; the join then finds them where they are.
    return rows.dropDuplicates([one, two]).join(kept, [one, two], "left_semi").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` is replaced by its kind, and ``n_chars``, where there is one, is the length of a text that changed.

    Null texts and texts without personal data stay as they are, repeated rows and null ids too; all rows and columns
    are kept; an empty table stays empty.
    """
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated, kept or left out so that the words of each source meet their target.

    A null source is one source, a null or empty text has no words and may be taken or left; repeated rows are sampled one by one.
    All columns are kept as they are; an empty table stays empty.
    """
    size = mixing.words("text")
    out = mixing.mix(docs, size, keep=docs.columns)
    # The operator's own columns may clash with those of the documents, so the kept ones are taken by place.
    kept = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
    copies = f"c{len(docs.columns) + 4}"
    each = kept.where(F.col(copies) > 0)
    each = each.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))))
    return each.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document in sequences of at most 2048 tokens.

    A null or empty text is the closing token alone; repeated rows and null ids are packed like others; an empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    return packing.pack(docs, tokenizer_path(), capacity=2048, last_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("SimHash near-dedup", deduplicated),
    ("PII", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

# SQL has no counterpart of the trained and hashed stages; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents in ``sf_dir``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

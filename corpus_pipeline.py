"""Documents to training sequences: quality, near-duplicates, target mixture, packing.

Each stage takes all rows that its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents, whatever other columns those have. No stage changes a text; a null
text counts as empty, repeated rows are rows of their own but for the near-duplicates, very long texts
count whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bag_minhash, mixing, packing, quality
from corpusloom.llm.common import materialize, table
from corpusloom.session import ship

#: Documents whose probability of being good is lower are rejected.
LEAST_QUALITY = 0.5
#: Share of the remaining tokens that the mixture is made of; no document is repeated.
MIX = {"fraction": 0.6, "max_epochs": 1, "seed": 7}


def _fresh(name: str, docs: DataFrame) -> str:
    """The name, or with underscores behind it, so that no column has it in any letter case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, gives ``LEAST_QUALITY`` or more.

    Null and empty texts get the share of good ones among the training rows; rows of equal text are kept
    or rejected together; without a label all are kept.
    """
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = _fresh("score", docs)
    return quality.score_documents(docs, model, keep=True, score_col=score).where(F.col(score) >= LEAST_QUALITY).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, then the smallest hash of its text.

    Of repeated rows one stays. Rows without an id and rows of empty or null text stay, but for repeated
    ones of an id.
    """
    ship(spark)
    return bag_minhash.keep_first(docs, materialize(bag_minhash.near_duplicates(docs), "near-classes"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mixture of domains, languages and sources, ``MIX`` of the tokens there are, each document once.

    A null language or source is a name of its own; documents without a token stay.
    """
    epoch = _fresh("epoch", docs)
    return mixing.mix_sources(docs, mixing.production_levels(), mixing.WEIGHTS, **MIX, epoch_col=epoch).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens, a row for each piece of a document; an empty text is the end id alone."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixing to target weights", mix_to_weights),
    ("packing", pack),
]

#: No SQL expresses the classifier or the signatures; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs

"""From raw documents to sampled token ids: quality, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has kept, and gives the
columns of documents; the last gives doc_id, ids, n_tokens and lossless for every serving of a
document in the mix. Stages read the columns they need (doc_id, text, source) and pass the others on,
whatever their names, as long as no two are the same; a column of the documents' own may be null in
any row. Texts of any length are taken whole. Rows may repeat and an empty table gives an empty table
at every stage; what a stage does with nulls, empty texts, ties and repeated rows it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnbridge.llm.common import checkpointed, table
from tarnbridge.llm.mixing import mixed_stream
from tarnbridge.llm.ngram_join import first_of_each
from tarnbridge.llm.pieces import encode_documents
from tarnbridge.llm.quality import keep_good
from tarnbridge.session import prepared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Each row is judged by its text alone, so equal texts stay or go together and repeated rows stay
    as often as they came. A null or empty text has the score of the bias; a score of 0.5 stays.
    Without labels of both classes all rows go with the one that there is, and stay without any.
    """
    return keep_good(docs, table(prepared(spark), sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose doc_id is least.

    Rows that are equal in doc_id and text stay once; of a doc_id with several texts each text counts
    for itself. Null, empty and wordless texts are alike to nothing and stay, as do all rows without
    a doc_id.
    """
    prepared(spark)
    return first_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in order of virtual finish time; a document can come twice.

    A null source is a source. Documents without words (null or empty texts) come once where they
    lie before the cut. Repeated rows are documents of their own; ties in the order are such rows.
    """
    prepared(spark)
    return mixed_stream(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in the mix.

    A null text has null ids and no tokens, an empty one the ids of the blank before it. The draw is seeded by doc_id, so servings of a
    document and repeated rows are cut alike; rows without a doc_id share a seed.
    """
    prepared(spark)
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("mixing", mixing), ("encoding", encoding)]

#: The classifier and the sampled encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

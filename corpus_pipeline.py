"""From raw documents to token ids: five stages, each written as Parquet before the next reads it.

Each stage takes (spark, docs, folder of tables) and works on all that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import decontaminate as _decontaminate
from axisframe.llm import mixing, resample, simhash, tokens
from axisframe.llm.common import fresh_path, written
from axisframe.llm.queries import MIX_TEMPERATURE, tokenizer_path
from axisframe.tables import table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose resampling key is among the largest stay: junk and toxic texts go.

    Null and empty texts weigh nothing and go or stay with the cut; rows that repeat fare alike, ties stay together.
    An empty table gives no rows; without labels of both kinds every document stays. Extra columns pass through.
    """
    return resample.resample(docs, table(spark, folder, "labels")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: that of least id.

    Near copies have a Jaccard similarity of 0.8 or more in five-word shingles, transitively. Null, empty and wordless
    texts are one group; of rows repeated in id and text one stays; rows without an id stay only where their group
    has no other. Extra columns pass through, and an empty table gives no rows.
    """
    return simhash.deduplicate(docs, similarity=0.8).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a window of the benchmark go.

    A row is judged by its own text, whatever its id, so repeated rows fare alike; null and wordless texts stay. An
    empty table or benchmark removes nothing. Extra columns pass through.
    """
    return _decontaminate.decontaminate(docs, table(spark, folder, "benchmark")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, laid out so that every stretch has the sources by their target weights.

    Every row comes back once: null ids, texts and sources (one source of their own), repeated rows and long texts are
    placed like any other. An empty table gives no rows. Extra columns pass through.
    """
    return mixing.in_order(mixing.mix(docs, temperature=MIX_TEMPERATURE)).select(docs.columns)


def file_order(docs: DataFrame) -> list[Column]:
    """The order of rows in the files that ``docs`` was read from: by part number, then by row.

    A frame that was not read from files has no order of its own; its doc_id stands in.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return [F.col("doc_id")]
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The token file of the mixed documents, read back: doc_id, part, start, n_tokens, ids, in the mixed order.

    A null or empty text is the end id alone; null and repeated ids are rows like any other. An empty table gives no
    rows. Extra columns are left behind.
    """
    path = fresh_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, tokenizer_path(), order=file_order(docs))
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID output", token_ids),
]

#: The classifier's hashing, SimHash and the tokenizer are not SQL; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = table(spark, folder, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if at + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs

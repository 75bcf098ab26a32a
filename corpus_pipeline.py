"""The training-data pipeline: five stages over `documents`, each on all that its predecessor kept.

What every stage makes of odd input:

* null and empty texts count as empty: they score as texts without words, are
  exact copies of each other, near copies and carriers of nothing, and are packed
  as an end id each;
* a null doc_id is kept as it is; of exact copies it counts as the smallest;
* repeated rows are exact copies, so one of them is left after that stage;
* very long texts are judged, compared and packed whole;
* of ties in a group the largest doc_id (exact) or the smallest (near) stays;
* an empty table gives an empty result; without labels of both classes toxicity
  keeps all rows, without benchmark items decontamination does;
* further columns, whatever their names, are kept as they are until packing.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from tremolo.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from tremolo.llm.common import mark, release, remove, table, work_dir


class _Begun(threading.local):
    """Where the work folders of this thread's running stage begin. A stage is given documents that have been written, so what earlier stages left can go."""

    at = 0


_begun = _Begun()


def _clear(spark: SparkSession) -> None:
    now = mark()
    release(spark, _begun.at, now)
    _begun.at = now


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more for toxicity."""
    _begun.at = mark()
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    _clear(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id."""
    _clear(spark)
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    _clear(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    _clear(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: Tokenisation and class models are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written as Parquet and read again as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = work_dir(spark, f"stage-{name}", listed=False)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:  # what the stage has read is not needed any more
            remove(spark, before)
        before = path

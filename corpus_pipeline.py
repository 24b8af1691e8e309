"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of documents, whatever others docs has
(also ones of names that the operators use), and an empty table for an empty one. A row in is looked at by itself or with
all others: none is dropped for its size, and repeated rows are rows each. What a stage does with nulls, empty and very
long texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import jaccard, mixing, packing, pii, toxicity
from kindred.llm.queries import table, tokenizer_path
from kindred.runtime import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    A null or empty text is not toxic and stays; a null id, source or language changes nothing; a probability right at the
    threshold is toxic; repeated documents are judged alike; very long texts are read whole. Without labels all stay.
    """
    return toxicity.clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    First is the smallest id; of rows that repeat it with texts of the group, the first row. Documents without words (null,
    empty, white space) are near nothing and all stay, and so do rows without id; rows that share an id but not the text
    belong to their own texts' groups. Very long texts are compared whole.
    """
    return jaccard.deduplicate(docs.select(*COLUMNS), percent=90, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the name of its kind, and n_chars brought up to date.

    A null text stays null and an empty one empty; overlapping finds are replaced once, by the kind of the first; repeated
    rows are masked each; very long texts are scanned whole; null ids, sources and languages stay as they are.
    """
    return pii.mask(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document is a repeated row, one taken no time is gone.

    One document of a source may be taken in part, its first words, so that the source meets its target. A null source is
    a source of its own, the last; a null or empty text has no words and is taken by its source's share; rows that repeat
    an id are drawn each; equal sizes are drawn in the order of ids; a very long text is one document like any other.
    """
    return mixing.apply(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids.

    A null or empty text is its end token alone; a null id stays null; repeated rows are packed each, equal lengths in the
    order of ids; very long texts are cut over many sequences. Only doc_id and text are looked at.
    """
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but PII masking could be put in SQL: trained weights, dependent draws and a tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and reread."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

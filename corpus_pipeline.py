"""The corpus pipeline: documents through five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from faultline.llm import langid, minhash, packing, pii, suffix
from faultline.llm.common import new_folder, scratch, table


def language_id(spark, docs, sf_dir):
    """Keeps the documents of which a third of the letters, at least, are in one known language."""
    return langid.keep_identified(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


def repeat_dedup(spark, docs, sf_dir):
    """Takes out passages of 100 bytes or more that an earlier document, or the same one, has already."""
    return suffix.remove_repeats(docs)


def redact_pii(spark, docs, sf_dir):
    """Replaces personal data by its kind in brackets."""
    return pii.redact(docs)


def pack(spark, docs, sf_dir):
    """Packs the documents into bins of words, each piece with its text; source and duplicate cluster conflict within a bin."""
    return packing.pack(docs, with_text=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("redact_pii", redact_pii), ("pack", pack)]

#: Viterbi labels, signatures and best fit have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of the cleaned documents, with their texts.

    Each stage's rows are written as Parquet and read again; a stage's own folders go once it is written. The stages'
    folders stay, as the result reads the last of them: `faultline.llm.common.release(spark)` deletes them after it has been used.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"{name}-")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: five stages from raw documents to a training mix.

1. quality rules: line cleaning; documents that fail go.
2. line dedup: lines found in ten documents or more go everywhere.
3. n-gram Jaccard join: of documents linked at similarity 0.8 on five-word
   shingles the one of least id stays.
4. benchmark decontamination: documents that leak a benchmark item go.
5. mixing sources to target weights: how many words of each document are taken.

Each stage gets all that the one before kept, read again from Parquet. All but the
last return the columns of documents.

Cases: a null or empty text has no words, so the first stage rejects its document; a text that
line dedup leaves empty stays through stages 2 to 4 and takes nothing in stage 5. Repeated rows are
judged one by one in stages 1, 2, 4 and 5, and one of them stays in stage 3. A null id is later
than all others in stage 3 and draws by its text in stage 5. A null source is one of its own. Other
columns pass through stages 1 to 4 whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from tarnweave.llm.common import cut
from tarnweave.llm.decontaminate import drop_leaks
from tarnweave.llm.line_dedup import dedup_lines
from tarnweave.llm.mixing import mix_sources
from tarnweave.llm.ngram_join import keep_one
from tarnweave.llm.quality import clean_documents

#: No SQL: banded alignment has no SQL form. tests/llm compares run() with a plain version instead.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the line rules and the whole-text rules keep, without their failing lines."""
    return clean_documents(docs)


def line_dedup(spark, docs, sf_dir):
    """The same documents without the lines that ten of them share."""
    return dedup_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: least id, then least text hash."""
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """The documents that hold no passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark, docs, sf_dir):
    """doc_id, size, source, source_size, target and taken of every document."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]


def run(spark, sf_dir):
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i + 1}")
    return docs

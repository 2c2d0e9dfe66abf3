"""Corpus pipeline: language, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and decides over all documents its predecessor kept;
all but the last return the columns of ``documents``. ``run`` writes each stage's result to
the shared work folder and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.llm import bpe, decontaminate, langid, secrets, simhash
from loadlens.llm.queries import BYTE_BPE, WORDS, table
from loadlens.llm.workers import is_training_row
from loadlens.session import write_and_read


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k, text): each document whole, whatever its columns are called, and its id and text
    hash, which tell rows apart but for exact repeats."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("k"),
                       "text")


def _rows(keyed: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs``, some of them changed."""
    return keyed.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _same(a: str, b: str):
    return (F.col(f"{a}.h") == F.col(f"{b}.h")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter in any learned language (``und``); others stay,
    with the predicted language as theirs, or with their own if no language could be learned."""
    model = langid.fit(docs.filter(is_training_row(F.col("doc_id"))),
                       public_tokenizers.path(BYTE_BPE))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    keyed = _keyed(docs)
    found = langid.predict(keyed, model, id_col="k").filter("lang_pred <> 'und'")
    found = write_and_read(found.groupBy(F.col("k").alias("own")).agg(
        F.first("lang_pred").alias("found")), "pipeline")
    return _rows(keyed.join(found, _same("k", "own")), docs, lang=F.col("found"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the one with the smallest id, the
    smallest text hash among equal ids, and one of exact repeats."""
    keyed = _keyed(docs)
    own = write_and_read(simhash.fingerprints(keyed, id_col="k"), "pipeline")
    named = simhash.fingerprint_components(own, "k").select(F.col("component_id").alias("own")).distinct()
    first = write_and_read(own.groupBy("k").agg(F.count(F.lit(1)).alias("copies")).join(
        named, _same("k", "own")).select("own", "copies"), "pipeline")
    kept = keyed.join(first, _same("k", "own"))
    alone = kept.filter("copies = 1").select("row")
    repeated = kept.filter("copies > 1").dropDuplicates(["k"]).select("row")
    return _rows(alone.unionByName(repeated), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    keyed = _keyed(docs)
    hit = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="k")
    hit = write_and_read(hit.filter("n_hit > 0").select(F.col("k").alias("own")).distinct(),
                         "pipeline")
    return _rows(keyed.join(hit, _same("k", "own"), "left_anti"), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    words = secrets.dictionary_words(spark, public_tokenizers.path(WORDS))
    found = write_and_read(secrets.scan(docs, words), "pipeline")
    clean = secrets.redact(docs, found)
    size = F.length("text").cast("bigint")
    return clean.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digest_tokens(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

# Learned models and hashes that SQL lacks: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

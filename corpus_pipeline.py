"""A training corpus from raw documents: five stages, each an operator of ``loamstack.llm`` on all that its predecessor kept.

1. ``language_id`` - texts without a letter (null ones too) go, as the operator rejects them; all others stay unchanged.
2. ``simhash_dedup`` - of each group of near duplicates the document with the least id stays. Two documents are linked if their
   SimHash fingerprints differ in at most four bits, as in ``op8_simhash`` (the covering code finds every such pair), or if they have
   0.8 or more of their five-word shingles in common (min-hashes find the candidates, the whole sets decide); groups hang together
   by links of both kinds.
3. ``substring_dedup`` - words under 35-word windows that start elsewhere too are cut; a document that loses all its words goes.
4. ``decontaminate`` - documents of which a twentieth or more repeats benchmark passages go; from others the passages are cut.
5. ``packing`` - what is left is tokenised and packed into sequences of 2048 tokens.

All stages but the last return the columns they got, with ``text`` (and ``n_chars``, if it is there) brought up to date. Stages go by
rows: a null or repeated id is no reason to go, and rows that share an id are judged each on its own text. Ties (of equal near
duplicates) are settled in ``simhash.drop_near_duplicates``. Null texts end at the first stage; the later ones pass them on unchanged
(``simhash_dedup`` takes texts without a word for equal). Empty tables stay empty. Extra columns pass through; their names must
not begin with the operators' own prefixes (``_ln_``, ``_sh_``, ``_ss_``, ``_dc_``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm import decontaminate, langid, packing, simhash, substring_dedup
from loamstack.llm._shared import read_table, written

def _with_text(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs``, with the text taken from another column."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit_on_folds(read_table(spark, sf_dir, "documents"))
    found = langid.predict(docs, model)
    return found.filter(F.col("_ln_lang") != langid.UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(docs)
    return _with_text(found.filter("_ss_n_words = 0 OR _ss_n_removed < _ss_n_words"), docs, "_ss_kept")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_benchmark(docs, read_table(spark, sf_dir, "benchmark"), clean=True)
    return _with_text(found.filter("_dc_n_hit = 0 OR _dc_n_hit * 20 < _dc_n_words"), docs, "_dc_clean")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", cut_repeats),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: No stage but decontamination can be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

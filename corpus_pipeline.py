"""From raw documents to token digests: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All stages but
the last return the columns of ``documents``.  As its docs are a written table,
a stage first removes what the operators of earlier stages left in the shared
folder.

Defined cases, at every stage: null text and text without letters go in the
first; null ids, languages, sources and counts stay as they are; repeated rows
are documents of their own until near-dedup keeps one of them (rows without an
id are never grouped); an empty table gives an empty result; texts of any
length are read whole; columns besides those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from persistra.llm import bpe, language_id, minhash_dedup, mixing, phrase_dedup
from persistra.llm.base import Scratch, table


#: what every stage but the last returns; further columns of the input are left out
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tidy() -> None:
    """Scratch of earlier stages goes, but not the table that ``run`` keeps this stage's docs in."""
    Scratch.clear(*[x for x in Scratch.made if "/scratch-pipeline-" in x.root])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; lang becomes the prediction, or stays where there was no row to learn from."""
    model = language_id.train(docs)
    if not model.langs:
        return language_id.lettered(docs, *COLUMNS)
    found = language_id.identify(docs, model, *COLUMNS).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the least id stays: the least digest, and of equal texts the least row."""
    _tidy()
    docs = docs.select(*COLUMNS, F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    found = minhash_dedup.near_duplicates(docs, carry=["digest"]).filter("doc_id is not null and label is not null")
    key = ["doc_id", "digest"]
    keys = Scratch(spark, "one").keep(found.groupBy(*key, "label", "kept").agg(F.count("*").alias("n")), "keys")
    stay = keys.filter("kept")
    other = stay.join(stay.groupBy("label").agg(F.min("digest").alias("least")), "label").filter("digest <> least")
    gone = keys.filter("not kept").select(*key).unionByName(other.select(*key))
    again = stay.filter("n > 1").select(*key).join(other.select(*key), key, "left_anti")
    # no key in these is null; <=> keeps the engine from filtering one side's docs, so both joins read one exchange of the texts
    same = F.expr("doc_id <=> one_id and digest <=> one_digest")
    of = lambda found: found.toDF("one_id", "one_digest")
    single = docs.join(of(gone.unionByName(again)), same, "left_anti").select(*COLUMNS)
    row = F.min(F.struct(*COLUMNS)).alias("row")
    return single.unionByName(docs.join(of(again), same, "left_semi").groupBy(*key).agg(row).select("row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages are cut out; texts that lose nothing stay as they are."""
    _tidy()
    cut = phrase_dedup.remove_repeats(docs, carry=COLUMNS)
    return cut.withColumn("n_chars", F.expr("if(n_removed > 0, length(text), n_chars)").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; every document is drawn at least once."""
    _tidy()
    return mixing.drawn(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document drawn."""
    _tidy()
    return bpe.encode_and_decode(docs, carry=["lang", "source"])


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: none: the stages train a classifier, walk automata and run a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries over the operators of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, deidentify, linking, mixing, near_dup, splitting, truncation
from chartloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "text_chunks"), table(spark, sf_dir, "chunk_limits"), "chunk_id", "profile", "text", "start_char")


@query("SELECT DISTINCT chunk_id FROM text_chunks JOIN chunk_limits USING (profile) WHERE length(text) > max_chars")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("chunk_id")


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


@query()
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


@query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, diagnoses = table(spark, sf_dir, "medical_events"), table(spark, sf_dir, "diagnoses")
    # An event's two columns are read in one pass.
    typed = events.select(F.explode(F.array("provider", "location")).alias("v")).unionAll(diagnoses.select("provider"))
    return linking.link(typed, "v", table(spark, sf_dir, "directory"))


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "directory").select("entity_id", F.col("canonical_name").alias("spelling"))
    return links(spark, sf_dir).select("entity_id", "spelling").join(own, ["entity_id", "spelling"], "left_anti")


@query()
def p3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("merge_round", "level").agg(F.count("*").alias("links"))


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_dup.near_duplicates(table(spark, sf_dir, "medical_events"), table(spark, sf_dir, "directory"), "event_id", "date", "provider", "description")
    return pairs.toDF("event_id_a", "event_id_b")


@query()
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "medical_events"), table(spark, sf_dir, "directory"), "event_id", "date", "provider", "description")


#: Secret of the surrogates in the queries below; a user passes their own.
SURROGATE_KEY = b"chartloom surrogates"


def _personal(spark: SparkSession, sf_dir: str) -> deidentify.Tables:
    events, claimants = table(spark, sf_dir, "medical_events"), table(spark, sf_dir, "claimants")
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("text"))
    notes = events.select(F.col("event_id").alias("record_id"), F.explode(F.array(field("source_text"), field("description"))).alias("f")).select("f.field", "record_id", "f.text")
    texts = notes.unionByName(claimants.select(F.lit("ssn").alias("field"), F.col("claimant_id").alias("record_id"), F.col("ssn").alias("text")))
    people = table(spark, sf_dir, "directory").where("kind = 'person'").select("canonical_name")
    return deidentify.deidentify(texts, deidentify.name_words([claimants.select("full_name"), people]), SURROGATE_KEY)


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify.items(_personal(spark, sf_dir)).select("field", "record_id", "kind", "start_char")


@query()
def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify.replaced(_personal(spark, sf_dir))


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).where("truncated").select("doc_id")


@query()
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(_truncated(spark, sf_dir), "source")

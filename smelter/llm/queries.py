"""The registered queries of the operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.llm import (
    anchor_bounds, chat, decontam, html_crf, mixing, parity_join, ppm, prefix_bpe, quality_eb, rules, sharding,
    spectrum, url_lists,
)
from smelter.llm.common import read_table


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], turns.schema)
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, one a day in turn; the list is a log made of their own hosts and paths.

    A page lists its host on its day (if its id divides by 3) or takes it off again; a page
    with an id that divides by 5 lists its first path segment or its whole path, and one that divides by 7
    the domain above its host, under labels of their own. Entries are spelled in several ways.
    """
    pages = read_table(spark, sf_dir, "pages")
    key = F.col("capture")
    captures = pages.select(F.col("page_id").alias("capture"), "url", (F.col("page_id") % 365).cast("int").alias("day"))
    host, path = url_lists.host_of("url"), url_lists.path_of("url")
    spelled = (
        F.when(key % 4 == 1, F.concat(F.upper(host), F.lit(".")))
        .when(key % 4 == 2, F.concat(F.lit("http://u@"), host, F.lit(":80/"))).otherwise(host)
    )
    hosts = captures.select(spelled.alias("pattern"), F.col("day"), F.lit("host").alias("label"), (key % 3 == 0).alias("listed"))
    first = F.concat(host, F.lit("/"), F.split(path, "/")[1])
    whole = F.concat(F.lit("HTTPS://"), host, F.lit("//"), F.substring(path, 2, 1_000_000), F.lit("//?q#f"))
    paths = captures.filter("capture % 5 = 0").select(
        F.when(key % 2 == 0, first).otherwise(whole).alias("pattern"),
        (F.col("day") + 7).alias("day"), F.lit("path").alias("label"), (key % 3 != 0).alias("listed"),
    )
    domains = captures.filter("capture % 7 = 0").select(
        F.regexp_replace(host, r"^[^.]*\.", "").alias("pattern"), (F.col("day") + 100).alias("day"),
        F.lit("domain").alias("label"), (key % 2 == 0).alias("listed"),
    )
    listed = hosts.unionByName(paths).unionByName(domains)
    return url_lists.judge(captures, listed).withColumnRenamed("capture", "page_id")


def op3_quality_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_eb.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "p_low", "p_toxic", "kept")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read_table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(read_table(spark, sf_dir, "documents"))


def op11_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return anchor_bounds.mine(rows, F.col("vec_id") % 50 == 0)


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes by the ranks of a public vocabulary file, then decodes what was encoded."""
    import public_tokenizers

    ranks = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    own = {"units": prefix_bpe.WORDS, "whole": prefix_bpe.LETTERS}
    ids = prefix_bpe.encode(docs, ranks, public_tokenizers.PATTERN, **own)
    encoded = docs.select("doc_id", ids.alias("ids"))
    decoded = encoded.select("doc_id", "ids", prefix_bpe.decode(encoded, ranks).alias("bytes"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op13_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    fits, scaled = anchor_bounds.whole_vectors(vectors, "embedding", 64)
    return spectrum.whiten(vectors.filter(fits).select("vec_id", F.transform(scaled, lambda c: c + 1_000_000).alias("x")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_targets, op2_url_lists, op3_quality_eb, op4_decision_list, op5_ppm, op6_mix, op7_main_text,
        op8_decontaminate, op9_feistel, op10_parity_join, op11_anchor_tree, op12_prefix_bpe, op13_spectrum,
        pipeline,
    )
}

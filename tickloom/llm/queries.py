"""Queries of the llm problems (p1, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import content, mixing, similar, tokens
from tickloom.registry import Registry, table

R = Registry()

FEATURES = 12
DISTANCES = f"""
with r as (select record_id, any_value(features) as features from analogue_record where record_id is not null group by 1),
 z as (select record_id, feature_key, cast(features[feature_key] as double) / cast(std_dev as double) as z from r cross join feature_stat where features[feature_key] is not null)"""


@R.query(
    "p1_found",
    f"""{DISTANCES},
 d as (select a.record_id as record_id_a, b.record_id as record_id_b, sqrt(avg((a.z - b.z) ** 2)) as d, count(*) as n
   from z a join z b on a.feature_key = b.feature_key and a.record_id < b.record_id group by 1, 2)
select record_id_a, record_id_b from d where n >= 10 and d <= 0.02
""",
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    v = similar.record_vectors(table(spark, folder, "analogue_record"), table(spark, folder, "feature_stat"), centre=False)
    return similar.similar_pairs(v, FEATURES, 0.02, 10).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


@R.query(
    "p1_links",
    f"""{DISTANCES},
 d as (select a.record_id as a, b.record_id as b, sqrt(avg((a.z - b.z) ** 2)) as d, count(*) as n from z a join z b on a.feature_key = b.feature_key and a.record_id <> b.record_id group by 1, 2),
 links as (select a, count(*) as links from d where n >= 10 and d <= 0.02 group by 1),
 known as (select record_id, list((feature_key, z) order by feature_key) as v from z group by 1)
select record_id, min(record_id) over (partition by v) as class_id, coalesce(links, 0) as links from known left join links on a = record_id
""",
)
def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: the class of equal feature vectors it is of, by its smallest record, and how many similar
    records p1_found pairs it with, without writing the pairs."""
    v = similar.record_vectors(table(spark, folder, "analogue_record"), table(spark, folder, "feature_stat"), centre=False)
    return similar.links(v, FEATURES, 0.02, 10).select(F.col("id").alias("record_id"), F.col("class").alias("class_id"), "links")


@R.query("p1_nearest")
def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar other records of every record."""
    v = similar.record_vectors(table(spark, folder, "analogue_record"), table(spark, folder, "feature_stat"), centre=True)
    near = similar.nearest_vectors(v, v, FEATURES, 10)
    return near.select(F.col("id").alias("record_id"), "neighbour", "rank", "distance")


@R.query(
    "p1_evidence_distance",
    f"""{DISTANCES},
 e as (select evidence_id, any_value(query_record_id) as q, any_value(average_distance) as stated, any_value(analogue_scenario_ids) as ids from temporal_evidence where evidence_id is not null group by 1),
 owner as (select scenario_id, min(record_id) as record_id from scenario_summary where record_id is not null group by 1),
 x as (select evidence_id, q, unnest(list_distinct(ids)) as scenario_id from e),
 d as (select x.evidence_id, x.scenario_id, sqrt(avg((a.z - b.z) ** 2)) as d from x join owner o using (scenario_id) join z a on a.record_id = x.q join z b on b.record_id = o.record_id and b.feature_key = a.feature_key
   group by 1, 2 having count(*) >= 5)
select e.evidence_id, cast(any_value(e.stated) as double) as stated, round(avg(d.d), 6) as average_distance, count(d.d) as analogues from e left join d using (evidence_id) group by 1
""",
)
def p1_evidence_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Each evidence row's stated average distance beside the mean distance of its query record to its analogues' records."""
    v = similar.distinct_vectors(similar.record_vectors(table(spark, folder, "analogue_record"), table(spark, folder, "feature_stat"), centre=False))
    e = table(spark, folder, "temporal_evidence").filter("evidence_id is not null").groupBy("evidence_id").agg(
        F.first("query_record_id").alias("q"), F.first("average_distance").alias("stated"), F.first("analogue_scenario_ids").alias("ids")
    )
    owner = table(spark, folder, "scenario_summary").filter("record_id is not null").groupBy("scenario_id").agg(F.min("record_id").alias("r"))
    pairs = e.select("evidence_id", "q", F.explode(F.array_distinct("ids")).alias("scenario_id")).join(owner, "scenario_id")
    pairs = pairs.join(v.select(F.col("id").alias("q"), F.col("vec").alias("a")), "q").join(v.select(F.col("id").alias("r"), F.col("vec").alias("b")), "r")
    sq = F.filter(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    d = pairs.select("evidence_id", sq.alias("sq")).filter(F.size("sq") >= 5)
    d = d.select("evidence_id", F.sqrt(F.aggregate("sq", F.lit(0.0), lambda s, x: s + x) / F.size("sq")).alias("d"))
    d = d.groupBy("evidence_id").agg(F.round(F.avg("d"), 6).alias("average_distance"), F.count("d").alias("analogues"))
    return e.join(d, "evidence_id", "left").select(
        "evidence_id", F.col("stated").cast("double").alias("stated"), "average_distance", F.coalesce("analogues", F.lit(0)).cast("bigint").alias("analogues")
    )


@R.query("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


@R.query("p8_mix")
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mixture and how often each is used."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


@R.query("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual share of each source in each mixture beside its target."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return content.score(docs, content.fitted(table(spark, folder, "content_example"), docs), keep=("source",))


@R.query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter(F.col("score") >= content.CUT).select("doc_id")


@R.query("p9_scores")
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).drop("source")


@R.query("p9_rates")
def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of documents with abusive, hateful or sexual content of each source."""
    return content.rates(_scored(spark, folder))

"""Record-linkage inputs out of the synthetic tables: the same rules in DataFrame form and in SQL (plans/oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithspark.session import table

#: The languages of the synthetic documents stand for the countries that have address rules.
COUNTRIES = {"en": "US", "de": "India", "fr": "France"}


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, name, addr, country, key, doc_id from documents."""
    s = F.substring("source", 4, 10).cast("int")
    src = F.when(s < 8, 1).when(s < 14, 2).otherwise(3).cast("byte")
    country = F.coalesce(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])[F.col("lang")], F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
        src.alias("src"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), F.substring("text", 61, 140)).alias("addr"),
        country.alias("country"),
        F.substring("text", 1, 60).alias("key"),
        "doc_id",
    )


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, records, truth) of er_records, with whatever more columns they have: truth gives each noisy record of a key
    to the key's first clean entity."""
    s1 = rows.filter("src = 1").drop("src")
    recs = rows.filter("src > 1")
    owner = s1.groupBy("key").agg(F.min("doc_id").alias("d")).select("key", F.concat(F.lit("S1-"), F.col("d").cast("string")).alias("s1_id"))
    truth = recs.join(owner, "key").select("s1_id", F.col("id").alias("rec_id"))
    return s1.drop("key", "doc_id"), recs.drop("key", "doc_id"), truth


def er_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, records, truth) out of documents."""
    return sides(er_records(spark, sf_dir))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, s1_id, src, p, y, sig from lineitem."""
    p = F.pmod(F.col("l_partkey") * 37 + F.col("l_orderkey") * 11 + F.col("l_linenumber") * 7, F.lit(1000)) / F.lit(1000.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_suppkey").alias("s1_id"), (F.lit(2) + F.col("l_linenumber") % 2).alias("src"),
        p.alias("p"), (F.col("l_returnflag") == "R").alias("y"), (F.col("l_partkey") % 7).alias("sig"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, country, name, addr out of part names, customer names (with #digits) and page hosts."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    hosts = table(spark, sf_dir, "pages").select(F.concat(F.lit("H-"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract("url", r"^https?://(?:[a-z]+\.)?([a-z]+)\.example(\.[a-z]+)", 1).alias("host"))
    hosts = hosts.select("id", F.concat(F.lit("@"), "host", F.lit(".com")).alias("name"))
    return parts.unionByName(customers).unionByName(hosts).select("id", F.lit("US").alias("country"), "name", F.lit("").alias("addr"))


#: Devanagari letters that stand for the 26 Latin ones in made-up native-script names.
NATIVE = "अआइईउऊएऐओऔकखगघचछजझटठडढतथदध"
LATIN = "abcdefghijklmnopqrstuvwxyz"


def native_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, records, truth) of part names: each entity's name in Latin script, its record's in letters of another one."""
    parts = table(spark, sf_dir, "part")
    blank = [F.lit("India").alias("country"), F.lit("").alias("addr")]
    of = lambda p, name: parts.select(F.concat(F.lit(p), F.col("p_partkey").cast("string")).alias("id"), name.alias("name"), *blank)
    s1, recs = of("S1-", F.col("p_name")), of("S2-", F.translate("p_name", LATIN, NATIVE)).withColumn("src", F.lit(2).cast("byte"))
    truth = parts.select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("s1_id"), F.concat(F.lit("S2-"), F.col("p_partkey").cast("string")).alias("rec_id"))
    return s1, recs, truth


def wrapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, country, name, addr: part names inside former names, with id tags and with dotted legal forms, each by turns."""
    k, n = F.col("p_partkey"), F.col("p_name")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("Old House Co. formerly known as: "), n, F.lit(" L.L.C.")))
        .when(k % 5 == 1, F.concat(n, F.lit(" (ID: "), k.cast("string"), F.lit(")")))
        .when(k % 5 == 2, F.concat(F.lit("Some Firm d/b/a "), n, F.lit(" P.C.")))
        .when(k % 5 == 3, F.concat(F.initcap(n), F.lit(" #"), k.cast("string"), F.lit(" S.A.R.L.")))
        .otherwise(F.concat(F.lit("The "), F.upper(n), F.lit(" & Co Pvt. Ltd.")))
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), k.cast("string")).alias("id"), F.lit("US").alias("country"), name.alias("name"), F.lit("").alias("addr"))


def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, country, name, addr: part names as web domains and handles."""
    k, n = F.col("p_partkey"), F.col("p_name")
    glued = F.replace(n, F.lit(" "), F.lit(""))
    name = F.when(k % 3 == 0, F.concat(F.lit("@"), glued)).when(k % 3 == 1, F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit(".com"))).otherwise(F.concat(F.upper(glued), F.lit("com")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), k.cast("string")).alias("id"), F.lit("US").alias("country"), name.alias("name"), F.lit("").alias("addr"))

"""The residue tables, made from the tables that are at hand, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    method = F.when(F.col("l_returnflag") == "A", "Predicted").when(F.col("l_returnflag") == "N", "X-ray").otherwise("NMR")
    return li.select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("Uniprot_Entry"), F.col("l_orderkey").cast("string").alias("PDB_Code"), method.alias("Method"),
        F.col("l_linestatus").alias("Chain"), F.col("l_linenumber").cast("int").alias("Resid"), F.when(F.col("l_linestatus") == "F", "relaxed").otherwise("unrelaxed").alias("Source"), F.col("l_returnflag").alias("class"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("propka"), F.col("l_extendedprice").alias("sasa"), (F.col("l_discount") * 220).alias("depth"), (F.col("l_tax") * 100).alias("seqcharge"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"),
    )


M = """measures AS (SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS Uniprot_Entry, CAST(l_orderkey AS VARCHAR) AS PDB_Code,
  CASE l_returnflag WHEN 'A' THEN 'Predicted' WHEN 'N' THEN 'X-ray' ELSE 'NMR' END AS Method, l_linestatus AS Chain, CAST(l_linenumber AS INT) AS Resid,
  CASE l_linestatus WHEN 'F' THEN 'relaxed' ELSE 'unrelaxed' END AS Source, l_returnflag AS class,
  CASE WHEN l_quantity <= 45 THEN l_quantity END AS propka, l_extendedprice AS sasa, l_discount * 220 AS depth, l_tax * 100 AS seqcharge,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_id FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("Resid"), F.lit("P1").alias("Uniprot_Entry"), F.when(F.col("vec_id") % 5 == 2, "Predicted").otherwise("X-ray").alias("Method"), F.col("embedding").cast("array<double>").alias("aev"))


V = "vectors AS (SELECT vec_id, label AS Resid, 'P1' AS Uniprot_Entry, CASE WHEN vec_id % 5 = 2 THEN 'Predicted' ELSE 'X-ray' END AS Method, CAST(embedding AS DOUBLE[]) AS aev FROM embeddings)"

NAMES = ("N", "CA", "C", "O", "CB", "SG", "NZ", "CG", "CD", "CE")
CODES = ("LYS", "CYS", "ASP", "GLU", "HIS", "ALA", "GLY", "HOH", "SER", "MSE")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    at = lambda k: F.col("embedding")[k].cast("double") * 40
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("S"), F.floor(i / 250).cast("string")).alias("structure"), F.lit(1).alias("model"), i.cast("int").alias("serial"), F.when(F.floor(i / 10) % 10 == 7, "HETATM").otherwise("ATOM").alias("record"),
        pick(NAMES, i % 10).alias("name"), F.when(i % 11 == 3, "A").when(i % 11 == 4, "B").otherwise("").alias("altloc"), pick(CODES, F.floor(i / 10) % 10).alias("resname"), F.col("label").cast("string").alias("chain"),
        F.floor(i / 10).cast("int").alias("resid"), F.when(i % 97 == 5, "A").otherwise("").alias("icode"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"),
        F.when(i % 7 == 0, 0.0).when(i % 11 == 3, 0.4).when(i % 11 == 4, 0.6).otherwise(1.0).alias("occupancy"), (F.col("embedding")[3].cast("double") * 100).alias("beta"), F.substring(pick(NAMES, i % 10), 1, 1).alias("element"),
    )


def _case(values: tuple, x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


A = f"""atoms AS (SELECT 'S' || CAST(vec_id // 250 AS VARCHAR) AS structure, 1 AS model, CAST(vec_id AS INT) AS serial, CASE WHEN (vec_id // 10) % 10 = 7 THEN 'HETATM' ELSE 'ATOM' END AS record,
  {_case(NAMES, '(vec_id % 10)')} AS name, CASE WHEN vec_id % 11 = 3 THEN 'A' WHEN vec_id % 11 = 4 THEN 'B' ELSE '' END AS altloc, {_case(CODES, '((vec_id // 10) % 10)')} AS resname,
  CAST(label AS VARCHAR) AS chain, CAST(vec_id // 10 AS INT) AS resid, CASE WHEN vec_id % 97 = 5 THEN 'A' ELSE '' END AS icode,
  CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z,
  CASE WHEN vec_id % 7 = 0 THEN 0.0 WHEN vec_id % 11 = 3 THEN 0.4 WHEN vec_id % 11 = 4 THEN 0.6 ELSE 1.0 END::DOUBLE AS occupancy, CAST(embedding[4] AS DOUBLE) * 100 AS beta,
  substr({_case(NAMES, '(vec_id % 10)')}, 1, 1) AS element FROM embeddings)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    some = li.filter("l_quantity >= 40").select("l_suppkey", "l_partkey").distinct()
    return some.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("go_id"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("uniprot")).distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("go_id")).agg(F.min("p_type").alias("name"))


E = """edges AS (SELECT DISTINCT p_brand AS go_id, 'P' || CAST(l_suppkey AS VARCHAR) AS uniprot FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40),
terms AS (SELECT p_brand AS go_id, min(p_type) AS name FROM part GROUP BY 1)"""


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.upper(F.substring("event_type", 1, 1))
    charge = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", letter.alias("letter"), charge.alias("charge"), "value", "props", "event_type")


R = "residues AS (SELECT event_id, user_id, ts, upper(substr(event_type, 1, 1)) AS letter, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS charge, value, props, event_type FROM events)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 3000")
    return s.select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("Uniprot_Entry"), F.explode(F.array(F.lit(1), F.lit(3))).alias("Resid"))


S = "sites AS (SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS Uniprot_Entry, unnest([1, 3]) AS Resid FROM supplier WHERE s_acctbal > 3000)"

"""Genotype-shaped tables derived from the driver's tables, by SQL that both engines run; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REFS = """SELECT p_partkey + 1000 AS rsid, CAST(1 + p_partkey % 3 AS BIGINT) AS format_id,
  CASE p_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST(p_partkey % 25 + 1 AS VARCHAR(9)) END AS chromosome,
  p_partkey * 37 + p_size AS position, CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' WHEN 4 THEN 'AC' ELSE 'ATG' END AS reference,
  CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'G' WHEN 2 THEN 'C, T' WHEN 3 THEN 'AT' WHEN 4 THEN 'GT,CA' WHEN 5 THEN 'A,AT' WHEN 6 THEN 'T' ELSE ' ,G' END AS alternates
FROM {part}"""

FORMATS = """SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'GRCh38' END AS genome_build FROM {region}"""

LOOKUP = """SELECT concat('rs', CAST(l_partkey + 1000 AS VARCHAR(20))) AS query_rsid, CAST(l_partkey % 22 + 1 AS VARCHAR(9)) AS query_chrom, CAST(l_suppkey AS VARCHAR(20)) AS query_pos,
  CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE CAST(l_partkey * 37 AS VARCHAR(20)) END AS ref_pos, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'G' END AS ref,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'C,T' END AS alt, CASE l_returnflag WHEN 'A' THEN 'Exact' WHEN 'N' THEN 'exact' ELSE 'window' END AS status,
  l_orderkey AS s1, l_linenumber AS s2, l_suppkey AS s3, l_extendedprice AS s4, l_returnflag AS s5 FROM {lineitem}"""

#: What a line of the pseudo-files holds, before it is written down: file is the order's priority, line_no its key.
CALLS = """SELECT o_orderpriority AS file_path, o_orderkey AS line_no, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('rs', CAST(o_orderkey AS VARCHAR(20))) END AS rsid,
  CASE o_custkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN '' ELSE CAST(o_custkey % 25 + 1 AS VARCHAR(9)) END AS chromosome,
  CASE WHEN o_custkey % 7 = 0 THEN 'x' WHEN o_custkey % 9 = 0 THEN '99999999999999999999' WHEN o_custkey % 5 = 0 THEN concat('+', CAST(o_custkey AS VARCHAR(20))) ELSE CAST(o_custkey AS VARCHAR(20)) END AS pos,
  CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'G' ELSE '' END AS a1, CASE WHEN o_orderkey % 3 = 0 THEN 'T' ELSE '' END AS a2 FROM {orders}"""

GENOTYPES = """SELECT concat('rs', CAST(o_orderkey AS VARCHAR(20))) AS rsid, CAST(o_custkey % 22 + 1 AS VARCHAR(9)) AS chromosome, CAST(o_custkey AS VARCHAR(20)) AS position,
  CASE o_orderstatus WHEN 'F' THEN 'AA' WHEN 'O' THEN 'AG' ELSE 'GG' END AS genotype, o_orderkey FROM {orders}"""
BASELINE = f"SELECT rsid, chromosome, position, genotype FROM ({GENOTYPES}) AS g WHERE o_orderkey % 10 <> 0"
CANDIDATE = f"SELECT rsid, chromosome, position, CASE WHEN o_orderkey % 13 = 0 THEN 'TT' ELSE genotype END AS genotype FROM ({GENOTYPES}) AS g WHERE o_orderkey % 7 <> 0"

#: Accessions, as helixlake.functions.contigs has them, for the chromosomes used here.
VCF = """SELECT CASE p_partkey % 5 WHEN 0 THEN 'NC_000001.11' WHEN 1 THEN 'NC_000002.12' WHEN 2 THEN 'NC_000003.12' WHEN 3 THEN 'NC_000023.11' ELSE 'NC_012920.1' END AS contig,
  p_partkey % 500 + 10 AS pos, CASE WHEN p_partkey % 4 = 0 THEN '.' WHEN p_partkey % 4 = 1 THEN concat('rs', CAST(p_partkey % 300 AS VARCHAR(20)), ';rs', CAST(p_partkey % 299 AS VARCHAR(20)))
  ELSE concat('rs', CAST(p_partkey % 300 AS VARCHAR(20))) END AS id, CASE WHEN p_size % 6 = 0 THEN 'ATTT' ELSE 'A' END AS ref,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 300 END AS rs_info, p_partkey AS file_order FROM {part}"""

QUERIES = """SELECT concat('rs', CAST(c_custkey % 300 AS VARCHAR(20))) AS rsid, CASE c_custkey % 7 WHEN 0 THEN '1' WHEN 1 THEN 'chr2' WHEN 2 THEN ' Chr3 ' WHEN 3 THEN 'x' WHEN 4 THEN 'M' WHEN 5 THEN '7' ELSE 'zz' END AS chromosome,
  c_custkey % 510 + 5 AS position, c_custkey FROM {customer}"""


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """Run sql on Spark; {name} is the driver's table of that name."""
    names = set(re.findall(r"\{(\w+)\}", sql)) - set(more)
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}, **more)


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)

"""Queries that go through files: writers write into the shared folder, readers read what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake import storage
from helixlake.operators import diff, lookup, store, summary, synthetic
from helixlake.plans import base, queries
from helixlake.plans.base import spark_sql
from helixlake.plans.queries import LOADED, PARSED, QUERIES, found_sql, query
from helixlake.schemas import LOOKUP_COLUMNS, LOOKUP_NEEDED
from helixlake.sinks import genotype_files, reports
from helixlake.sources import files, genotype_text, tables


def _path(spark, name):
    return f"{storage.new_path(spark, 'query')}/{name}"


def _text(spark, lines, order, before=""):
    """A file of the column line, by order; without one as the lines come."""
    path = _path(spark, "lines.txt")
    storage.write_text_file((lines.orderBy(*order) if order else lines).select("line"), path, before)
    return path


# --- lookup CSV and the store -----------------------------------------------------------------------------------------

BLANK_REF = f"""SELECT query_rsid, query_chrom, query_pos, ref_pos, CASE WHEN s2 = 4 THEN '' ELSE ref END AS ref, alt, status, s1, s2, s3, s4, s5 FROM ({base.LOOKUP}) AS l"""


#: The columns that base.LOOKUP calls s1 to s5.
LOOKUP_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag"]


def _lookup_csv(spark, sf_dir, sql=base.LOOKUP):
    """The table is sorted before its texts are made: the shuffle has its few narrow columns, and the sort, which reads its input twice, makes no text."""
    in_order = spark_sql(spark, sf_dir, "SELECT * FROM {lineitem}").orderBy(*LOOKUP_ORDER)
    rows = spark_sql(spark, sf_dir, sql, lineitem=in_order).select(reports.csv_line(LOOKUP_NEEDED).alias("line"))
    return _text(spark, rows, [], ",".join(LOOKUP_NEEDED) + "\n")


@query(f"SELECT rsid, CAST(1 AS BIGINT) AS format_id, chromosome, position, reference, alternates FROM ({LOADED}) AS n")
def store_load(spark, sf_dir):
    """A CSV file into a new store, and the store opened again by a reader."""
    home = _path(spark, "store")
    store.Store(spark, home).load_lookup(tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir)))
    return store.Store(spark, home, create=False).read("references")


#: Suppliers as the rows of a second load: some of its markers are known, some are new.
SECOND = """SELECT concat('rs', CAST(s_suppkey * 32 + 1003 AS VARCHAR(20))) AS query_rsid, CAST(s_nationkey % 22 + 1 AS VARCHAR(9)) AS query_chrom, '' AS query_pos, CAST(s_suppkey * 11 AS VARCHAR(20)) AS ref_pos, 'T' AS ref, 'A' AS alt,
  CASE WHEN s_suppkey % 5 = 0 THEN 'window' ELSE 'exact' END AS status, s_suppkey AS s1, 0 AS s2, 0 AS s3, 0 AS s4, 0 AS s5 FROM {supplier}"""
LOADED_SECOND = f"SELECT CAST(substr(query_rsid, 3) AS BIGINT) AS rsid, query_chrom AS chromosome, CAST(ref_pos AS BIGINT) AS position, ref AS reference, alt AS alternates FROM ({SECOND}) AS s WHERE status = 'exact'"


def _loaded_twice(spark, sf_dir):
    """A store after two loads, its buckets' files before and after the second one, and the second one's counters."""
    kept = store.Store(spark, _path(spark, "store"))
    kept.load_lookup(tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir)))
    before = kept.state("references")["files"]
    counts = kept.load_lookup(tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir, SECOND)))
    return kept, before, kept.state("references")["files"], counts


@query(f"""SELECT coalesce(n.rsid, o.rsid) AS rsid, CAST(1 AS BIGINT) AS format_id, coalesce(n.chromosome, o.chromosome) AS chromosome, coalesce(n.position, o.position) AS position, coalesce(n.reference, o.reference) AS reference,
  coalesce(n.alternates, o.alternates) AS alternates FROM ({LOADED}) AS o FULL JOIN ({LOADED_SECOND}) AS n ON n.rsid = o.rsid""")
def store_two_loads(spark, sf_dir):
    """A second load merged into the first one's buckets."""
    return _loaded_twice(spark, sf_dir)[0].read("references")


@query(f"""SELECT coalesce(o.bucket, n.bucket) AS bucket, n.bucket IS NOT NULL AS rewritten, CAST((SELECT count(*) FROM (SELECT rsid FROM ({LOADED}) AS l UNION SELECT rsid FROM ({LOADED_SECOND}) AS m) AS u WHERE rsid % 16 = coalesce(o.bucket, n.bucket)) AS BIGINT) AS rows
  FROM (SELECT DISTINCT CAST(rsid % 16 AS INTEGER) AS bucket FROM ({LOADED}) AS l) AS o FULL JOIN (SELECT DISTINCT CAST(rsid % 16 AS INTEGER) AS bucket FROM ({LOADED_SECOND}) AS m) AS n ON o.bucket = n.bucket""")
def store_rewritten_buckets(spark, sf_dir):
    """Which buckets the second load wrote anew: those of its keys; the others' files are the first load's."""
    _, before, after, _ = _loaded_twice(spark, sf_dir)
    rows = [(k, before.get(k, [None])[0] != version, n) for k, (version, n) in after.items()]  # a row a bucket
    return spark.createDataFrame(rows, "bucket int, rewritten boolean, rows long")


@query(f"SELECT CAST(count(*) FILTER (WHERE status = 'exact') AS BIGINT) AS imported, CAST(count(*) FILTER (WHERE status <> 'exact') AS BIGINT) AS skipped FROM ({SECOND}) AS s")
def store_load_counters(spark, sf_dir):
    """The counters of a load, from the pass that stores its rows."""
    return spark.createDataFrame([_loaded_twice(spark, sf_dir)[3]], "imported long, skipped long")


@query(f"SELECT rsid, chromosome, position, reference, alternates, (SELECT count(*) FROM ({base.LOOKUP}) AS a) AS lookup_rows FROM ({LOADED}) AS l")
def store_after_failed_load(spark, sf_dir):
    """A good load, then one of the same rows and a bad one, which must fail: the store is as the good load left it."""
    kept = store.Store(spark, _path(spark, "store"))
    lookup = tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir))
    kept.load_lookup(lookup)
    bad = lookup.withColumn("query_rsid", F.when(F.col("query_rsid") == F.lit("rs1001"), "none").otherwise(F.col("query_rsid"))).withColumn("status", F.lit("exact"))
    try:
        kept.load_lookup(bad)
    except Exception as error:
        if "no valid rsid" not in str(error):
            raise
    else:
        raise AssertionError("a bad row was loaded")
    return kept.read("references").select("rsid", "chromosome", "position", "reference", "alternates", F.lit(lookup.count()).cast("long").alias("lookup_rows"))


@query(f"""SELECT query_rsid AS rsid, query_chrom AS chromosome, query_pos AS position, ref AS reference, replace(alt, ',', '/') AS alternates FROM ({BLANK_REF}) AS l WHERE status = 'exact' AND ref <> ''""")
def lookup_csv_exact_rows(spark, sf_dir):
    rows = tables.exact_rows(tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir, BLANK_REF)))
    return rows.select("rsid", "chromosome", "position", "reference", F.array_join("alternates", "/").alias("alternates"))


@query("""SELECT o_orderstatus AS file_path, CAST(count(*) + 1 AS BIGINT) AS variant_count, CAST(7 AS BIGINT) AS skipped_rows FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus
  UNION ALL SELECT 'P', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM {orders} WHERE o_orderstatus = 'P' HAVING count(*) > 0""")
def manifest_merge(spark, sf_dir):
    """Files that are recorded again have their new counts."""
    old = spark_sql(spark, sf_dir, "SELECT o_orderstatus AS file_path, count(*) AS variant_count, CAST(0 AS BIGINT) AS skipped_rows FROM {orders} GROUP BY o_orderstatus")
    new = old.where("file_path <> 'P'").select("file_path", (F.col("variant_count") + 1).alias("variant_count"), F.lit(7).cast("long").alias("skipped_rows"))
    home = store.Store(spark, _path(spark, "store"))
    home.record_files(old)
    home.record_files(new)
    return home.read("manifest")


# --- genotype text ----------------------------------------------------------------------------------------------------


@query(f"SELECT left(file_path, 1) AS file, * EXCLUDE (file_path) REPLACE (row_number() OVER (PARTITION BY file_path ORDER BY line_no) + CASE WHEN file_path LIKE '5%' THEN 1 ELSE 0 END AS line_no) FROM ({PARSED}) AS p")
def genotype_file_rows(spark, sf_dir):
    """All orders in five files, written and parsed: tabs and commas, headers in the first line, in a comment, in another order."""
    calls, paths = spark_sql(spark, sf_dir, base.CALLS), []
    tabs, quoted = F.concat_ws("\t", "rsid", "chromosome", "pos", "a1", "a2"), F.concat_ws(",", *[F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("rsid", "a2", "pos", "chromosome", "a1")])
    heads = {"1-URGENT": (tabs, "rsid\tchr\tpos\tallele1\tallele2\n"), "2-HIGH": (quoted, "Marker,Allele_B,Coordinate,CHROM,allele_a\n"), "3-MEDIUM": (tabs, "## SNP\tchrom\tBase Pair\tAllele1 - Top\tallele2\n"),
             "4-NOT SPECIFIED": (tabs, "// id\tchromosome\tposition\tallele1\tallele2\n"), "5-LOW": (quoted, "# written for a test\nname,alleleb,pos,chr,allelea\n")}
    for name, (line, head) in heads.items():
        path = f"{storage.new_path(spark, 'query')}/{name[0]}.txt"
        storage.write_text_file(calls.where(F.col("file_path") == name).withColumn("line", line).orderBy("line_no").select("line"), path, head)
        paths.append(path)
    rows = genotype_text.read_genotypes(spark, paths).withColumn("file", F.regexp_extract("file_path", "([0-9])[.]txt$", 1))
    return rows.select("file", "line_no", "rsid", "chromosome", "position", "allele1", "allele2", "outcome")


LATE = "SELECT r_regionkey, 2046 + r_regionkey AS blank, p_partkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY p_partkey) - 1 AS k FROM {region}, {part}"


@query(f"""SELECT CAST(r_regionkey AS VARCHAR) AS file, blank + k AS line_no, CASE WHEN blank < 2048 THEN 'rs' || p_partkey ELSE 'rs' || p_partkey || ',1,' || p_partkey || ',AA,more' END AS rsid, CASE WHEN blank < 2048 THEN '1' END AS chromosome,
  CASE WHEN blank < 2048 THEN p_partkey END AS position, CASE WHEN blank < 2048 THEN 'AA' END AS genotype, CASE WHEN blank < 2048 THEN 'parsed' ELSE 'skipped' END AS outcome FROM ({LATE}) AS r""")
def late_first_lines(spark, sf_dir):
    """All parts in a file for each region, behind blank lines: the first line is the last, or beyond the last, that shows the delimiter; surplus fields."""
    paths = []
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect():
        lines = spark_sql(spark, sf_dir, "SELECT p_partkey, concat('rs', p_partkey, ',1,', p_partkey, ',AA,more') AS line FROM {part}").orderBy("p_partkey")
        paths.append(f"{storage.new_path(spark, 'query')}/{r[0]}.txt")
        storage.write_text_file(lines.select("line"), paths[-1], "".join("\n" if k % 2 else " \t \n" for k in range(2046 + r[0])))
    rows = genotype_text.read_genotypes(spark, paths).withColumn("file", F.regexp_extract("file_path", "([0-9]+)[.]txt$", 1))
    return rows.select("file", "line_no", "rsid", "chromosome", "position", "genotype", "outcome")


MARKERS = """SELECT p_partkey AS n, CASE WHEN p_partkey % 7 = 0 THEN concat('#rs', CAST(p_partkey AS VARCHAR(20)), chr(9), '1', chr(9), '5') WHEN p_partkey % 11 = 0 THEN concat('rs', CAST(p_partkey AS VARCHAR(20)), chr(9), '1')
  ELSE concat('rs', CAST(p_partkey AS VARCHAR(20)), chr(9), CAST(p_partkey % 22 + 1 AS VARCHAR(9)), chr(9), CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 3 = 0 THEN concat('1_', CAST(p_size AS VARCHAR(9))) ELSE CAST(p_size AS VARCHAR(9)) END, chr(9), 'AG') END AS line FROM {part}"""


@query("""SELECT 'rs' || p_partkey AS rsid, CAST(p_partkey % 22 + 1 AS VARCHAR) AS chromosome, CAST(CASE WHEN p_partkey % 3 = 0 THEN '1' || p_size ELSE '' || p_size END AS BIGINT) AS position, line_no
  FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS line_no FROM {part}) AS p WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 ORDER BY line_no LIMIT 50""")
def first_markers(spark, sf_dir):
    return tables.marker_rows(genotype_text.read_lines(spark, [_text(spark, spark_sql(spark, sf_dir, MARKERS), ["n"])]), 50)


@query("""SELECT 'rs' || o_custkey AS rsid, CAST(o_orderkey % 22 + 1 AS VARCHAR) AS chromosome, '' || o_orderkey AS position, o_orderstatus || 'A' AS genotype
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM {orders}) AS o WHERE k = 1""")
def genotype_map_last_wins(spark, sf_dir):
    lines = spark_sql(spark, sf_dir, "SELECT o_orderkey, concat('rs', o_custkey, chr(9), o_orderkey % 22 + 1, chr(9), o_orderkey, chr(9), o_orderstatus, 'A') AS line FROM {orders}")
    return tables.genotype_map(genotype_text.read_lines(spark, [_text(spark, lines, ["o_orderkey"], "# rsid\trow of four fields\nshort\t1\n")]))


# --- VCF --------------------------------------------------------------------------------------------------------------

VCF_TEXT = f"""SELECT v.*, CASE file_order % 3 WHEN 0 THEN '.' WHEN 1 THEN 'G' ELSE 'G,T' END AS alt, CASE file_order % 4 WHEN 0 THEN '.' WHEN 1 THEN 'PASS' ELSE 'q10;s50' END AS filter FROM ({base.VCF}) AS v"""
VCF_HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def _vcf_file(spark, sf_dir):
    info = F.concat(F.lit("VC=SNV"), F.coalesce(F.concat(F.lit(";RS="), F.col("rs_info").cast("string")), F.lit("")))
    rows = spark_sql(spark, sf_dir, VCF_TEXT).withColumn("line", F.concat_ws("\t", "contig", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), "filter", info))
    return _text(spark, rows, ["file_order"], VCF_HEAD)


@query(f"""SELECT contig, pos, id, ref, CASE alt WHEN '.' THEN '' ELSE replace(alt, ',', '/') END AS alts, CASE WHEN filter <> '.' THEN replace(filter, ';', '/') END AS filters, CAST(rs_info AS VARCHAR) AS rs,
  row_number() OVER (ORDER BY file_order) + 1 AS line_no FROM ({VCF_TEXT}) AS t""")
def vcf_text_records(spark, sf_dir):
    rows = tables.read_vcf_text(spark, [_vcf_file(spark, sf_dir)])
    return rows.select("contig", "pos", "id", "ref", F.array_join("alts", "/").alias("alts"), F.array_join("filters", "/").alias("filters"), F.array_join(F.col("info_rs").cast("array<string>"), ",").alias("rs"), F.col("file_order").alias("line_no"))


ROUTED = f"""SELECT CASE status WHEN 'exact' THEN 'exact' ELSE 'other' END AS file, rsid AS query_rsid, chromosome AS query_chrom, CAST(position AS VARCHAR) AS query_pos, CASE WHEN pos IS NULL THEN '' ELSE contig END AS ref_contig, coalesce(CAST(pos AS VARCHAR), '') AS ref_pos,
  coalesce(ref, '') AS ref, CASE WHEN pos IS NULL THEN '' ELSE CASE file_order % 3 WHEN 0 THEN '' WHEN 1 THEN 'G' ELSE 'G,T' END END AS alt, CASE WHEN pos IS NULL THEN '' ELSE CASE WHEN file_order % 4 < 2 THEN 'PASS' ELSE 'q10;s50' END END AS filters, status
  FROM ({found_sql(50, more='chromosome, position, file_order,')}) AS t"""


@query(ROUTED)
def routed_csv_rows(spark, sf_dir):
    """Lookups against a converted and pruned table, written to two files and read back."""
    asked, vcf = spark_sql(spark, sf_dir, base.QUERIES), tables.read_vcf(spark, _vcf_file(spark, sf_dir))
    found = lookup.find_records(asked, lookup.prune_records(vcf, asked, 50), 50, known=vcf.select("contig").distinct())
    paths = {name: _path(spark, f"{name}.csv") for name in ("exact", "other")}
    reports.write_routed_csv(lookup.lookup_rows(found, "c_custkey"), paths["exact"], paths["other"], ["c_custkey"])
    schema = ", ".join(f"{c} string" for c in LOOKUP_COLUMNS)
    read = [spark.read.csv(p, header=True, schema=schema, escape='"').select(F.lit(name).alias("file"), *[F.coalesce(c, F.lit("")).alias(c) for c in LOOKUP_COLUMNS]) for name, p in paths.items()]
    return read[0].unionByName(read[1])


# --- reports ----------------------------------------------------------------------------------------------------------


@query(f"""SELECT 4 + row_number() OVER (ORDER BY f.name, r.rsid) AS line_no, '<tr><td>' || f.name || '</td><td>rs' || r.rsid || '</td><td class="count" data-sort-value="1">1</td></tr>' AS html
  FROM ({base.REFS}) AS r JOIN ({base.FORMATS}) AS f ON f.id = r.format_id""")
def report_file_lines(spark, sf_dir):
    """The rows of a report's file, in its order."""
    refs, path = queries.refs(spark, sf_dir), _path(spark, "report.html")
    reports.write_html_report(path, summary.coverage_rows(spark_sql(spark, sf_dir, base.FORMATS), refs), summary.coverage_summary(refs).first().asDict(), "store")
    lines = genotype_text.read_lines(spark, [path]).where(F.col("value").startswith("<tr><td>"))
    return lines.select("line_no", F.col("value").alias("html"))


@query(f"""SELECT 'format' AS list, CAST(row_number() OVER (ORDER BY n DESC, id) - 1 AS INTEGER) AS place, name AS value, n AS count FROM (SELECT f.id, f.name, count(r.rsid) AS n FROM ({base.FORMATS}) AS f LEFT JOIN ({base.REFS}) AS r ON f.id = r.format_id GROUP BY ALL) AS x
  UNION ALL SELECT 'build', CAST(row_number() OVER (ORDER BY n DESC, genome_build NULLS FIRST) - 1 AS INTEGER), genome_build, n FROM (SELECT genome_build, count(*) AS n FROM ({base.FORMATS}) AS g GROUP BY genome_build) AS y""")
def summary_lists(spark, sf_dir):
    """What the summary lists, and in which order."""
    one = summary.summary(spark_sql(spark, sf_dir, base.FORMATS), queries.refs(spark, sf_dir))
    out = [one.select(F.lit(name).alias("list"), F.posexplode(f"{name}s_seen").alias("place", "e")).select("list", "place", "e.value", "e.count") for name in ("format", "build")]
    return out[0].unionByName(out[1])


@query(f"""SELECT CAST(count(*) AS BIGINT) AS files_processed, CAST(sum(variant_count) AS BIGINT) AS total_variants, CAST(sum(skipped_rows) AS BIGINT) AS skipped_rows, CAST((SELECT count(*) FROM ({base.REFS}) AS r) AS BIGINT) AS unique_rsids
  FROM ({queries.ORACLE_SQL['per_file_stats']}) AS s""")
def summary_json_file(spark, sf_dir):
    """The counts of parsed files, through the summary's file."""
    path = _path(spark, "summary.json")
    reports.write_summary_json(path, summary.summary(spark_sql(spark, sf_dir, base.FORMATS), queries.refs(spark, sf_dir), "p", QUERIES["per_file_stats"](spark, sf_dir)))
    counts = "files_processed long, total_variants long, skipped_rows long, unique_rsids long"
    return spark.createDataFrame([(storage.read_text(spark, path),)], "text string").select(F.from_json("text", counts).alias("s")).select("s.*")


@query(f"""WITH d AS ({queries.DIFF}), b AS ({base.BASELINE}), c AS ({base.CANDIDATE}), n AS (SELECT count(*) FILTER (WHERE change <> 'added') AS b, count(*) FILTER (WHERE change <> 'missing') AS c, count(*) FILTER (WHERE change = 'missing') AS m,
    count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'changed') AS x FROM d),
  k AS (SELECT rsid, change, row_number() OVER (PARTITION BY change ORDER BY rsid) AS r FROM d)
SELECT 0 AS line_no, format('Baseline rows: {{:,}}', b) AS line FROM n UNION ALL SELECT 1, format('Candidate rows: {{:,}}', c) FROM n UNION ALL SELECT 2, format('Missing in candidate: {{:,}}', m) FROM n
UNION ALL SELECT 3, format('Not present in baseline: {{:,}}', a) FROM n UNION ALL SELECT 4, format('Genotype/position differences: {{:,}}', x) FROM n
UNION ALL SELECT 4 + r, '- ' || k.rsid || ': baseline ' || b.chromosome || ':' || b.position || ' ' || b.genotype || ' vs candidate ' || c.chromosome || ':' || c.position || ' ' || c.genotype FROM k JOIN b ON b.rsid = k.rsid JOIN c ON c.rsid = k.rsid WHERE change = 'changed' AND r <= 5
UNION ALL SELECT 10, '... ' || (x - 5) || ' more differences omitted' FROM n
UNION ALL SELECT CASE change WHEN 'missing' THEN 11 ELSE 12 END, CASE change WHEN 'missing' THEN 'Sample missing rsids: ' ELSE 'Sample new rsids: ' END || string_agg(rsid, ', ' ORDER BY rsid) FROM k WHERE change IN ('missing', 'added') AND r <= 5 GROUP BY change""")
def diff_report_lines(spark, sf_dir):
    both = diff.compare(spark_sql(spark, sf_dir, base.BASELINE), spark_sql(spark, sf_dir, base.CANDIDATE))
    return spark.createDataFrame(list(enumerate(reports.diff_report(both, 5).split("\n"))), "line_no int, line string")


# --- synthetic files --------------------------------------------------------------------------------------------------


def _written(spark, sf_dir):
    folder = _path(spark, "synthetic")
    plans = spark.range(3).select(F.col("id").alias("file_idx"), F.concat(F.lit(f"{folder}/"), F.col("id"), F.lit(".txt")).alias("path"))
    return folder, genotype_files.write_genotype_files(queries.synthetic_with_overlays(spark, sf_dir), plans)


@query(f"""SELECT file_idx || '.txt' AS file, 17 + row_number() OVER (PARTITION BY file_idx ORDER BY leftover, chromosome, position, rsid) AS line_no,
  concat_ws(chr(9), 'rs' || rsid, chromosome, CAST(position AS VARCHAR), genotype, gs, baf, lrr) AS line FROM ({queries.ORACLE_SQL['synthetic_overlay_rows']}) AS s""")
def synthetic_file_lines(spark, sf_dir):
    """The lines after the header of the files of synthetic rows with overlays, in their order."""
    folder, _ = _written(spark, sf_dir)
    lines = genotype_text.read_lines(spark, [f"{folder}/{k}.txt" for k in range(3)])
    return lines.where("line_no >= 18").select(F.substring_index("file_path", "/", -1).alias("file"), "line_no", F.col("value").alias("line"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows FROM ({queries.ORACLE_SQL['synthetic_file_counts']}) AS s")
def synthetic_totals(spark, sf_dir):
    return _written(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


GENERATED = f"""SELECT place AS rsid, 1 AS format_id, query_chrom AS chromosome, query_pos AS position, ref AS reference, alt AS alternates, query_rsid
  FROM (SELECT *, row_number() OVER (ORDER BY s1, s2, s3, s4, s5) AS place FROM ({BLANK_REF}) AS l) AS p WHERE status = 'exact' AND ref <> ''"""


@query(f"""SELECT 17 + row_number() OVER (ORDER BY rsid) AS line_no, concat_ws(chr(9), query_rsid, chromosome, position, genotype, gs, baf, lrr) AS line
  FROM (SELECT query_rsid, chromosome, position, genotype, rsid, {queries.METRICS} FROM ({queries.OWN.replace(base.REFS, GENERATED).replace('range(3)', 'range(1)')}) AS w) AS s""")
def generated_file_lines(spark, sf_dir):
    """The lines after the header of the older generator's file, made of a lookup's exact rows in their order."""
    rows = tables.exact_rows(tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir, BLANK_REF)))
    path = _path(spark, "generated.txt")
    genotype_files.write_generated_file(synthetic.generated_rows(rows, spark.createDataFrame([(0,)], "file_idx long"), 0.25, 7), path)
    return genotype_text.read_lines(spark, [path]).where("line_no >= 18").select("line_no", F.col("value").alias("line"))


BROKEN = f"""SELECT query_rsid, query_chrom, query_pos, ref_pos, CASE WHEN s2 = 1 THEN concat('A', chr(10), 'T') WHEN s2 = 2 THEN concat(chr(10), chr(10), '"C",', chr(10), 'G') ELSE ref END AS ref,
  CASE WHEN s2 = 3 THEN concat('"', chr(10), '"') ELSE alt END AS alt, status, s1, s2, s3, s4, s5 FROM ({base.LOOKUP}) AS l"""


@query(f"""SELECT query_rsid AS rsid, query_pos AS position, ref_pos, trim(replace(ref, chr(10), '|'), '|') AS ref, replace(alt, chr(10), '|') AS alt, status, count(*) AS n FROM ({BROKEN}) AS l GROUP BY ALL""")
def lookup_csv_line_breaks(spark, sf_dir):
    """Values with line breaks and quotes, written and read back in splits."""
    rows = tables.read_lookup_csv(spark, _lookup_csv(spark, sf_dir, BROKEN))
    shown = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit("|"))
    return rows.groupBy(F.col("query_rsid").alias("rsid"), F.col("query_pos").alias("position"), "ref_pos", F.btrim(shown("ref"), F.lit("|")).alias("ref"), shown("alt").alias("alt"), "status").agg(F.count(F.lit(1)).alias("n"))


# --- discovery --------------------------------------------------------------------------------------------------------

#: A file for each nation, in a folder for each region: candidates by their endings, hidden names, others, and empty ones.
NATION_FILES = """SELECT n_nationkey, n_regionkey, concat(CASE WHEN n_nationkey % 6 = 4 THEN '.h' WHEN n_nationkey % 6 = 5 THEN '_' ELSE 'f' END, CAST(100 + n_nationkey AS VARCHAR(9)),
  CASE n_nationkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.TSV' WHEN 2 THEN '' WHEN 3 THEN '.vcf' ELSE '.csv' END) AS name, n_nationkey % 7 = 3 AS empty FROM {nation}"""
EMPTY = "(empty OR n_nationkey NOT IN (SELECT c_nationkey FROM {customer}))"
CANDIDATES = f"SELECT *, row_number() OVER (ORDER BY n_regionkey, name) - 1 AS place FROM ({NATION_FILES}) AS f WHERE n_nationkey % 5 <> 3"


def _nation_folders(spark, sf_dir):
    """Each nation's customers, written by tasks into the folder of its region."""
    home, parts = storage.new_path(spark, "query"), storage.new_path(spark, "parts")
    lines = spark_sql(spark, sf_dir, "SELECT c_nationkey, concat('rs', c_custkey, chr(9), 1, chr(9), c_custkey, chr(9), 'AA') AS line FROM {customer}")
    lines.repartition("c_nationkey").write.partitionBy("c_nationkey").text(parts)
    for r in spark_sql(spark, sf_dir, NATION_FILES).collect():
        own, path = f"{parts}/c_nationkey={r['n_nationkey']}", f"{home}/{r['n_regionkey']}/{r['name']}"
        written = storage.names(spark, own)
        if r["empty"] or not written:
            storage.write_bytes(spark, path, b"")
        else:
            storage.move(spark, f"{own}/{written[0]}", path)
    return home


@query(f"SELECT CAST(place AS INTEGER) AS place, CAST(n_regionkey AS VARCHAR) AS folder, name, CASE WHEN {EMPTY} THEN 'file is empty' ELSE '' END AS error FROM ({CANDIDATES}) AS c WHERE place < 18")
def discovered_files(spark, sf_dir):
    """Candidates of folders in the order of their paths, the first eighteen, and those that cannot be read."""
    found = files.discover(spark, [_nation_folders(spark, sf_dir)], 18)
    _, failures = files.split_failures(spark, found)
    paths = spark.createDataFrame([(k, p, *p.split("/")[-2:]) for k, p in enumerate(found)], "place int, file_path string, folder string, name string")
    return files.with_errors(paths, failures).select("place", "folder", "name", "error")


@query(f"""SELECT f.name, CAST(count(*) AS BIGINT) AS variant_count, CAST(0 AS BIGINT) AS skipped_rows FROM ({NATION_FILES}) AS f JOIN {{customer}} ON c_nationkey = f.n_nationkey
  WHERE f.n_nationkey % 5 <> 3 AND NOT f.empty GROUP BY f.name""")
def discovered_file_stats(spark, sf_dir):
    """Every readable candidate parsed and counted, those with hidden names included."""
    good, _ = files.split_failures(spark, files.discover(spark, [_nation_folders(spark, sf_dir)]))
    stats = genotype_text.file_stats(genotype_text.read_genotypes(spark, good))
    return stats.select(F.substring_index("file_path", "/", -1).alias("name"), "variant_count", "skipped_rows")

"""The catalogue: each query on Spark through the operators, and its SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake import storage
from helixlake.functions.contigs import CONTIGS, contig_of
from helixlake.functions.text import html_escape, parse_long, parse_python_int, parse_rsid, split_quoted, strip_inline_comment
from helixlake.functions.variants import genotype_combinations, split_alternates, synthesize_genotype, variant_kind
from helixlake.operators import diff, lookup, overlay, store, summary, synthetic
from helixlake.plans import base
from helixlake.plans.base import duck, spark_sql
from helixlake.sinks.reports import html_rows
from helixlake.sources import genotype_text, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = duck(sql)
        return function

    return add


def refs(spark, sf_dir):
    return spark_sql(spark, sf_dir, base.REFS)


# --- classification and genotypes ------------------------------------------------------------------------------------

ALTS = "list_filter(list_transform(string_split(alternates, ','), lambda x: trim(x)), lambda x: x <> '')"
KIND = """CASE WHEN len(a) = 0 THEN 'snp' WHEN strlen(reference) = 1 AND len(list_filter(a, lambda x: strlen(x) <> 1)) = 0 THEN 'snp'
  WHEN strlen(reference) > 1 AND len(list_filter(a, lambda x: strlen(x) <> strlen(reference))) = 0 THEN 'mnv' WHEN strlen(a[1]) > strlen(reference) THEN 'insertion'
  WHEN strlen(a[1]) < strlen(reference) THEN 'deletion' ELSE 'mnv' END"""
KINDS = f"SELECT *, {KIND} AS kind FROM (SELECT *, {ALTS} AS a FROM ({base.REFS}) AS r) AS q"


@query(f"SELECT kind, count(*) AS n FROM ({KINDS}) GROUP BY kind")
def variant_kind_counts(spark, sf_dir):
    kinds = refs(spark, sf_dir).select(variant_kind(F.col("reference"), split_alternates(F.col("alternates"))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rsid, kind, array_to_string(a, '/') AS alts FROM ({KINDS})")
def variant_kinds(spark, sf_dir):
    rows = refs(spark, sf_dir).withColumn("a", split_alternates(F.col("alternates")))
    return rows.select("rsid", variant_kind(F.col("reference"), F.col("a")).alias("kind"), F.array_join("a", "/").alias("alts"))


@query(f"""SELECT rsid, string_agg(x || y, ' ' ORDER BY x, y) AS genotypes FROM (SELECT rsid, unnest(s) AS x, s FROM (SELECT rsid, list_distinct(list_concat([reference], a)) AS s FROM ({KINDS})) q) p,
  LATERAL (SELECT unnest(s) AS y) WHERE x <= y GROUP BY rsid""")
def genotype_options(spark, sf_dir):
    pairs = genotype_combinations(F.col("reference"), split_alternates(F.col("alternates")))
    return refs(spark, sf_dir).select("rsid", F.array_join(pairs, " ").alias("genotypes"))


@query(f"""SELECT rsid, use_alt, CASE kind WHEN 'snp' THEN allele || allele WHEN 'mnv' THEN left(allele, 1) || left(allele, 1) WHEN 'insertion' THEN CASE WHEN u THEN 'II' ELSE 'DD' END
  ELSE CASE WHEN u THEN 'DD' ELSE 'II' END END AS genotype FROM (SELECT *, use_alt AND len(a) > 0 AS u, CASE WHEN use_alt AND len(a) > 0 THEN a[1] ELSE reference END AS allele
  FROM (SELECT k.*, b.use_alt FROM ({KINDS}) k, (VALUES (true), (false)) b(use_alt)) z) y""")
def genotype_synthesis(spark, sf_dir):
    both = refs(spark, sf_dir).withColumn("use_alt", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("rsid", "use_alt", synthesize_genotype(F.col("reference"), split_alternates(F.col("alternates")), F.col("use_alt"), F.lit(0)).alias("genotype"))


# --- the store --------------------------------------------------------------------------------------------------------


@query(f"SELECT rsid, chromosome, position, reference, alternates FROM ({base.REFS}) AS r ORDER BY chromosome, position, rsid LIMIT 100")
def refs_ordered_limit(spark, sf_dir):
    return store.ordered_references(refs(spark, sf_dir), 100)


@query(f"SELECT rsid, chromosome, position, reference, alternates FROM ({base.REFS}) AS r ORDER BY chromosome, position, rsid")
def refs_ordered(spark, sf_dir):
    return store.ordered_references(refs(spark, sf_dir))


def _lookup(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, base.LOOKUP)
    return rows.withColumn("seq", F.struct("s1", "s2", "s3", "s4", "s5")).drop("s1", "s2", "s3", "s4", "s5")


LOADED = f"""SELECT * FROM (SELECT CAST(substr(query_rsid, 3) AS BIGINT) AS rsid, query_chrom AS chromosome, CAST(CASE WHEN ref_pos = '' THEN query_pos ELSE ref_pos END AS BIGINT) AS position,
  ref AS reference, alt AS alternates, row_number() OVER (PARTITION BY query_rsid ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC) AS rn FROM ({base.LOOKUP}) AS l WHERE lower(status) = 'exact') AS x WHERE rn = 1"""


@query(f"SELECT rsid, chromosome, position, reference, alternates FROM ({LOADED}) AS n")
def lookup_load_last_wins(spark, sf_dir):
    return store.last_wins(store.typed_lookup(_lookup(spark, sf_dir)), "rsid", F.col("seq")).drop("seq")


@query(f"""SELECT coalesce(o.rsid, n.rsid) AS rsid, coalesce(o.format_id, 1) AS format_id, coalesce(n.chromosome, o.chromosome) AS chromosome, coalesce(n.position, o.position) AS position,
  coalesce(n.reference, o.reference) AS reference, coalesce(n.alternates, o.alternates) AS alternates FROM (SELECT * FROM ({base.REFS}) AS r WHERE rsid % 3 <> 0) AS o FULL JOIN ({LOADED}) AS n ON o.rsid = n.rsid""")
def reference_upsert(spark, sf_dir):
    return store.upsert(refs(spark, sf_dir).where("rsid % 3 <> 0"), store.typed_lookup(_lookup(spark, sf_dir)))


@query(f"SELECT count(*) FILTER (WHERE lower(status) = 'exact') AS imported, count(*) FILTER (WHERE lower(status) <> 'exact') AS skipped FROM ({base.LOOKUP}) AS l")
def load_counters(spark, sf_dir):
    return store.load_counters(_lookup(spark, sf_dir))


@query(f"SELECT id, name, genome_build FROM ({base.FORMATS}) AS f WHERE id > 1 UNION ALL SELECT 1, 'dynamic_dna', 'GRCh38'")
def formats_seeded(spark, sf_dir):
    return store.seed_formats(spark_sql(spark, sf_dir, base.FORMATS).where("id > 1"))


@query("SELECT DISTINCT o_orderpriority AS file_path FROM {orders} WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM {orders} WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%')")
def unrecorded_files(spark, sf_dir):
    files = spark_sql(spark, sf_dir, "SELECT DISTINCT o_orderpriority AS file_path FROM {orders}")
    return store.not_recorded(files, files.where("file_path LIKE '1%' OR file_path LIKE '3%'"))


# --- summaries --------------------------------------------------------------------------------------------------------


def _formats(spark, sf_dir):
    return spark_sql(spark, sf_dir, base.FORMATS)


@query(f"SELECT f.name AS value, count(r.rsid) AS count FROM ({base.FORMATS}) AS f LEFT JOIN ({base.REFS}) AS r ON f.id = r.format_id GROUP BY f.id, f.name")
def formats_seen(spark, sf_dir):
    return summary.format_counts(_formats(spark, sf_dir), refs(spark, sf_dir))


@query(f"SELECT genome_build AS value, count(*) AS count FROM ({base.FORMATS}) AS f GROUP BY genome_build")
def builds_seen(spark, sf_dir):
    return summary.build_counts(_formats(spark, sf_dir))


@query(f"SELECT f.name AS format, r.rsid, 1 AS count FROM ({base.REFS}) AS r JOIN ({base.FORMATS}) AS f ON f.id = r.format_id")
def coverage_rows(spark, sf_dir):
    return summary.coverage_rows(_formats(spark, sf_dir), refs(spark, sf_dir))


@query(f"SELECT count(DISTINCT format_id) AS unique_formats, count(*) AS unique_rsids, count(*) AS total_rows FROM ({base.REFS}) AS r")
def coverage_summary(spark, sf_dir):
    return summary.coverage_summary(refs(spark, sf_dir))


@query(f"""SELECT 0 AS files_processed, (SELECT count(*) FROM ({base.REFS}) AS r WHERE format_id IN (SELECT id FROM ({base.FORMATS}) AS f)) AS total_variants, (SELECT count(*) FROM ({base.REFS}) AS r) AS unique_rsids,
  0 AS skipped_rows, (SELECT count(*) FROM ({base.FORMATS}) AS f) AS formats, (SELECT count(DISTINCT coalesce(genome_build, '')) FROM ({base.FORMATS}) AS f) AS builds""")
def summary_parity(spark, sf_dir):
    one = summary.summary(_formats(spark, sf_dir), refs(spark, sf_dir))
    return one.select("files_processed", "total_variants", "unique_rsids", "skipped_rows", F.size("formats_seen").alias("formats"), F.size("builds_seen").alias("builds"))


@query(f"""SELECT f.name AS format, r.rsid, '<tr><td>' || f.name || '</td><td>rs' || r.rsid || '</td><td class="count" data-sort-value="1">1</td></tr>' AS html
  FROM ({base.REFS}) AS r JOIN ({base.FORMATS}) AS f ON f.id = r.format_id""")
def report_rows(spark, sf_dir):
    return html_rows(summary.coverage_rows(_formats(spark, sf_dir), refs(spark, sf_dir)))


# --- parsing ----------------------------------------------------------------------------------------------------------

CALL_ROWS = f"""SELECT file_path, line_no, rsid, chromosome, pos, a1, a2, CASE WHEN rsid <> '' AND chromosome <> '' AND regexp_matches(pos, '^[+]?[0-9]{{1,18}}$') AND (a1 <> '' OR a2 <> '') THEN 'parsed' ELSE 'skipped' END AS outcome
  FROM ({base.CALLS}) AS c"""
PARSED = f"""SELECT file_path, line_no, nullif(rsid, '') AS rsid, nullif(chromosome, '') AS chromosome, CASE WHEN regexp_matches(pos, '^[+]?[0-9]{{1,18}}$') THEN CAST(pos AS BIGINT) END AS position,
  nullif(a1, '') AS allele1, nullif(a2, '') AS allele2, outcome FROM ({CALL_ROWS}) AS p"""


def _calls(spark, sf_dir):
    return spark_sql(spark, sf_dir, base.CALLS)


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    return lines.unionByName(lines.select("file_path").distinct().select("file_path", F.lit(-1).cast("long").alias("line_no"), F.lit(header).alias("value")))


def _parsed(lines: DataFrame) -> DataFrame:
    return genotype_text.parse_lines(lines).select("file_path", "line_no", "rsid", "chromosome", "position", "allele1", "allele2", "outcome")


@query(PARSED)
def raw_line_parse_tab(spark, sf_dir):
    """A comment header, tabs, spaces around fields, inline comments."""
    lines = _calls(spark, sf_dir).select("file_path", "line_no", F.concat_ws("\t", "rsid", F.concat(F.lit(" "), "chromosome"), "pos", "a1", F.concat("a2", F.lit(" // note # more"))).alias("value"))
    return _parsed(_with_header(lines, "## RS-ID\tChr_\tBase Pair Position\tAllele1 - Top\tallele_b"))


@query(PARSED)
def raw_line_parse_comma(spark, sf_dir):
    """A real header in another order, quoted fields with doubled quotes, an extra column of that kind."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    lines = _calls(spark, sf_dir).select("file_path", "line_no", F.concat_ws(",", quoted("rsid"), quoted("a2"), F.lit('"x, ""y"" z"'), quoted("pos"), quoted("chromosome"), "a1").alias("value"))
    return _parsed(_with_header(lines, 'Marker,"Allele 2",remark,Coordinate,CHROM,"Allele_A"'))


#: Without a header, the first line's number of fields is that of the columns; empty fields close up.
SPACED = f"""SELECT file_path, line_no, f[1] AS rsid, CASE WHEN width > 1 THEN f[2] END AS chromosome, CASE WHEN width > 2 AND regexp_matches(f[3], '^[+]?[0-9]{{1,18}}$') THEN CAST(f[3] AS BIGINT) END AS position, CASE WHEN width > 3 THEN f[4] END AS genotype,
  CASE WHEN width > 3 AND len(f) > 3 AND regexp_matches(f[3], '^[+]?[0-9]{{1,18}}$') THEN 'parsed' ELSE 'skipped' END AS outcome
  FROM (SELECT *, arg_min(len(f), line_no) OVER (PARTITION BY file_path) AS width FROM (SELECT file_path, line_no, list_filter([rsid, chromosome, pos, a1 || a2], lambda x: x <> '') AS f FROM ({base.CALLS}) AS c) AS g) AS h"""


@query(SPACED)
def raw_line_parse_space(spark, sf_dir):
    """No header, any white space between fields; where a field is empty, those behind it move up."""
    lines = _calls(spark, sf_dir).select("file_path", "line_no", F.concat(F.lit("  "), F.col("rsid"), F.lit("   "), F.col("chromosome"), F.lit(" "), F.col("pos"), F.lit("  "), F.concat("a1", "a2")).alias("value"))
    return genotype_text.parse_lines(lines).select("file_path", "line_no", "rsid", "chromosome", "position", "genotype", "outcome")


@query(f"SELECT file_path, count(*) FILTER (WHERE outcome = 'parsed') AS variant_count, count(*) FILTER (WHERE outcome = 'skipped') AS skipped_rows FROM ({CALL_ROWS}) AS p GROUP BY file_path")
def per_file_stats(spark, sf_dir):
    lines = _calls(spark, sf_dir).select("file_path", "line_no", F.concat_ws("\t", "rsid", "chromosome", "pos", "a1", "a2").alias("value"))
    return genotype_text.file_stats(genotype_text.parse_lines(_with_header(lines, "# snp\tchrom\tpos\tallele1\tallele2")))


@query("""SELECT p_partkey AS line_no, CASE WHEN p_partkey % 3 <> 0 THEN 'i' || p_partkey ELSE 'rs' || p_partkey END AS rsid, CASE WHEN p_partkey % 5 = 0 THEN 'GG' WHEN p_partkey % 2 = 0 THEN 'TT' ELSE 'AA' END AS genotype FROM {part}""")
def header_alias_priority(spark, sf_dir):
    """id comes before rsid, call before genotype; of two columns of one name the last counts, even if it is empty."""
    line = """concat_ws('\t', CASE WHEN p_partkey % 3 <> 0 THEN concat('i', p_partkey) ELSE '' END, concat('rs', p_partkey), '1', '5', CASE WHEN p_partkey % 2 = 0 THEN 'TT' ELSE 'AA' END, 'zz', CASE WHEN p_partkey % 5 = 0 THEN 'GG' ELSE '' END)"""
    lines = spark_sql(spark, sf_dir, f"SELECT 'f' AS file_path, p_partkey AS line_no, {line} AS value FROM {{part}}")
    return genotype_text.parse_lines(_with_header(lines, "id\trsid\tchr\tpos\tgenotype\tcall\tcall")).select("line_no", "rsid", "genotype")


@query("""SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END) AS value FROM {part}""")
def inline_comment_strip(spark, sf_dir):
    text = "CASE WHEN p_partkey % 3 = 0 THEN concat('\t', p_name, '  # ', p_brand, ' // x') WHEN p_partkey % 3 = 1 THEN concat('//', p_name) ELSE concat(p_type, '//', p_brand, '# y') END"
    return spark_sql(spark, sf_dir, f"SELECT p_partkey, {text} AS t FROM {{part}}").select("p_partkey", strip_inline_comment(F.col("t")).alias("value"))


@query("""SELECT p_partkey, p_name || '|' || p_brand || ',"' || p_type || '|' || p_size AS fields FROM {part}""")
def quoted_fields(spark, sf_dir):
    line = """concat('"', p_name, '", ', '"', p_brand, ',""', p_type, '"', ' ,', p_size)"""
    return spark_sql(spark, sf_dir, f"SELECT p_partkey, {line} AS line FROM {{part}}").select("p_partkey", F.array_join(split_quoted(F.col("line")), "|").alias("fields"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN -o_custkey ELSE o_custkey END AS strict, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN -o_custkey WHEN 3 THEN o_custkey * 10 + 5 ELSE o_custkey END AS loose,
  CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN -o_custkey ELSE o_custkey END AS rsid FROM {orders}""")
def integer_parsing(spark, sf_dir):
    text = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_custkey, '') WHEN 1 THEN concat('+', o_custkey) WHEN 2 THEN concat('-', o_custkey) WHEN 3 THEN concat(o_custkey, '_5') ELSE concat(o_custkey, '.5') END"
    rows = spark_sql(spark, sf_dir, f"SELECT o_orderkey, {text} AS t FROM {{orders}}")
    return rows.select("o_orderkey", parse_long(F.col("t")).alias("strict"), parse_python_int(F.concat(F.lit(" "), F.col("t"), F.lit("\t"))).alias("loose"), parse_rsid(F.concat(F.lit("rsrs"), F.col("t"))).alias("rsid"))


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(c_name || '<&>"' || c_mktsegment || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM {customer}""")
def escaped_names(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, "SELECT c_custkey, c_name, c_mktsegment FROM {customer}")
    return rows.select("c_custkey", html_escape(F.concat("c_name", F.lit('<&>"'), "c_mktsegment", F.lit("'"))).alias("html"))


# --- differences ------------------------------------------------------------------------------------------------------

DIFF = f"""SELECT coalesce(b.rsid, c.rsid) AS rsid, b.genotype AS baseline_genotype, c.genotype AS candidate_genotype, CASE WHEN c.rsid IS NULL THEN 'missing' WHEN b.rsid IS NULL THEN 'added'
  WHEN b.chromosome = c.chromosome AND b.position = c.position AND b.genotype = c.genotype THEN 'same' ELSE 'changed' END AS change FROM ({base.BASELINE}) AS b FULL JOIN ({base.CANDIDATE}) AS c ON b.rsid = c.rsid"""


def _compared(spark, sf_dir):
    return diff.compare(spark_sql(spark, sf_dir, base.BASELINE), spark_sql(spark, sf_dir, base.CANDIDATE))


@query(DIFF)
def genotype_diff_rows(spark, sf_dir):
    return _compared(spark, sf_dir).select("rsid", F.col("baseline.genotype").alias("baseline_genotype"), F.col("candidate.genotype").alias("candidate_genotype"), "change")


@query(f"""SELECT count(*) FILTER (WHERE change <> 'added') AS baseline_rows, count(*) FILTER (WHERE change <> 'missing') AS candidate_rows, count(*) FILTER (WHERE change = 'missing') AS missing,
  count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'changed') AS differences FROM ({DIFF}) AS d""")
def genotype_diff_summary(spark, sf_dir):
    return diff.diff_summary(_compared(spark, sf_dir))


def _first(change):
    @query(f"SELECT rsid FROM ({DIFF}) AS d WHERE change = '{change}' ORDER BY rsid LIMIT 20")
    def first(spark, sf_dir):
        return diff.first_changes(_compared(spark, sf_dir), change, 20).select("rsid")

    name = f"genotype_diff_{change}"
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("first"), ORACLE_SQL.pop("first")


for _change in ("missing", "added", "changed"):
    _first(_change)


# --- lookup against records -------------------------------------------------------------------------------------------

CONTIG = "CASE regexp_replace(upper(trim(chromosome)), '^CHR', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTIGS.items()) + " END"
BASE_VCF = f"SELECT *, pos - 1 + length(ref) AS stop FROM ({base.VCF}) AS b"


def ids_sql(vcf: str) -> str:
    return f"""SELECT DISTINCT v.contig, v.pos, v.ref, v.stop, v.file_order, i.record_id FROM ({vcf}) AS v,
  LATERAL (SELECT unnest(list_concat(list_filter(string_split(v.id, ';'), lambda x: x <> '.'), CASE WHEN v.rs_info IS NULL THEN [] ELSE ['rs' || v.rs_info] END)) AS record_id) AS i"""


def found_sql(window: int = 0, before: int | None = None, after: int = 0, more: str = "", source: str = base.QUERIES, vcf: str = BASE_VCF, declared: str = "") -> str:
    """declared: more contigs that exist, as a list of SQL texts."""
    over = lambda b, a: f"greatest(0, q.position - {b}) < q.position + {a} AND r.pos - 1 < q.position + {a} AND r.stop > greatest(0, q.position - {b})"
    exact, near = over(1, 0), over(1 + window, window) if before is None else f"(({over(1, 0)}) OR ({over(before, after)}))"
    also = f" AND contig NOT IN ({declared})" if declared else ""
    return f"""SELECT c_custkey, rsid, {more} contig, pos, ref, CASE WHEN contig IS NULL THEN 'no_contig' WHEN contig NOT IN (SELECT contig FROM ({vcf}) AS k){also} THEN 'missing_contig' WHEN pos IS NULL THEN 'not_found'
      WHEN exact THEN 'exact' ELSE 'window' END AS status FROM (SELECT q.c_custkey, q.rsid, q.chromosome, q.position, q.contig, r.pos, r.ref, r.file_order, {exact} AS exact,
      row_number() OVER (PARTITION BY q.c_custkey ORDER BY CASE WHEN {exact} THEN 0 ELSE 1 END, r.pos, r.file_order) AS rn
      FROM (SELECT *, {CONTIG} AS contig FROM ({source}) AS u) AS q LEFT JOIN ({ids_sql(vcf)}) AS r ON q.contig = r.contig AND q.rsid = r.record_id AND {near}) AS z WHERE rn = 1"""


def _found(spark, sf_dir, window=0, before=None, after=None, asked=None):
    vcf = spark_sql(spark, sf_dir, base.VCF).select("contig", "pos", "id", "ref", F.array(F.lit("G")).alias("alts"), F.lit(None).cast("array<string>").alias("filters"),
                                                    F.when(F.col("rs_info").isNotNull(), F.array("rs_info")).alias("info_rs"), "file_order")
    return lookup.find_records(spark_sql(spark, sf_dir, base.QUERIES) if asked is None else asked, vcf, window, before, after)


@query(found_sql(0))
def position_lookup_exact(spark, sf_dir):
    return _found(spark, sf_dir, 0).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


@query(found_sql(50))
def position_lookup_window(spark, sf_dir):
    return _found(spark, sf_dir, 50).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


@query(found_sql(before=30, after=10))
def position_lookup_uneven(spark, sf_dir):
    return _found(spark, sf_dir, before=30, after=10).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


@query(found_sql(50, source=f"SELECT rsid, chromosome, position, max(CAST(c_custkey AS VARCHAR)) AS c_custkey FROM ({base.QUERIES}) AS a GROUP BY rsid, chromosome, position"))
def position_lookup_derived(spark, sf_dir):
    """Queries that an aggregation makes, with a text column kept."""
    asked = spark_sql(spark, sf_dir, base.QUERIES).groupBy("rsid", "chromosome", "position").agg(F.max(F.col("c_custkey").cast("string")).alias("c_custkey"))
    return _found(spark, sf_dir, 50, asked=asked).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


@query(f"SELECT status, count(*) AS n FROM ({found_sql(50)}) AS s GROUP BY status")
def lookup_status_counts(spark, sf_dir):
    return lookup.status_counts(_found(spark, sf_dir, 50))


@query(f"""SELECT rsid AS query_rsid, coalesce(contig, '') AS ref_contig, coalesce(CAST(pos AS VARCHAR), '') AS ref_pos, coalesce(ref, '') AS ref, CASE WHEN pos IS NULL THEN '' ELSE 'G' END AS alt, CASE WHEN pos IS NULL THEN '' ELSE 'PASS' END AS filters, status
  FROM (SELECT rsid, CASE WHEN pos IS NULL THEN NULL ELSE contig END AS contig, pos, ref, status FROM ({found_sql(50)}) AS s) AS t""")
def lookup_table(spark, sf_dir):
    return lookup.lookup_rows(_found(spark, sf_dir, 50)).drop("query_chrom", "query_pos")


@query(f"SELECT DISTINCT chromosome, {CONTIG} AS contig FROM ({base.QUERIES}) AS u")
def contig_names(spark, sf_dir):
    return spark_sql(spark, sf_dir, base.QUERIES).select("chromosome", contig_of(F.col("chromosome")).alias("contig")).distinct()


@query(f"SELECT contig, pos, id, ref FROM ({base.VCF}) AS v WHERE id = 'rs42'")
def records_by_id(spark, sf_dir):
    vcf = spark_sql(spark, sf_dir, base.VCF).withColumn("alts", F.array(F.lit("G")))
    return tables.by_id(vcf, "rs42").select("contig", "pos", "id", "ref")


# --- synthetic files --------------------------------------------------------------------------------------------------

OVERLAY_JSON = """{"g1": {"description": "ignored", "variants": [{"rsid": "rs1005", "chromosome": "7", "position": 77, "reference": "A", "alternates": ["C", "G"]},
  {"rsid": "1006", "chromosome": "8", "position": 88, "genotypes": ["AT", "TT"]}]}, "g2": {"variants": [{"rsid": "rsrs9", "chromosome": "9", "position": 99, "reference": "I", "alternates": ["D"]},
  {"rsid": "rs10", "chromosome": "1", "position": 1, "reference": "G", "alternates": ["A", "C", "T"]}, {"rsid": "rs11", "chromosome": "2", "position": 2, "reference": "T"}]}}"""
OVERLAYS = """(VALUES (1005, '7', 77, ['AA', 'AC', 'AG', 'CC', 'CG', 'GG']), (1006, '8', 88, ['AT', 'TT']), (9, '9', 99, ['DD', 'DI', 'II']),
  (10, '1', 1, ['AA', 'AC', 'AG', 'AT', 'CC', 'CG', 'CT', 'GG', 'GT', 'TT']), (11, '2', 2, ['TT'])) AS o(rsid, chromosome, position, options)"""


def _draw(stream: str) -> str:
    return f"CAST('0x' || substr(md5('7:' || file_idx || ':' || rsid || ':{stream}'), 1, 8) AS BIGINT)"


METRICS = f"""CAST(CAST((2000 + {_draw('gs')} % 8001) / 10000.0 AS DECIMAL(12, 4)) AS VARCHAR) AS gs, CAST(CAST(({_draw('baf')} % 1001) / 1000.0 AS DECIMAL(12, 3)) AS VARCHAR) AS baf,
  CAST(CAST(({_draw('lrr')} % 10001 - 5000) / 10000.0 AS DECIMAL(12, 4)) AS VARCHAR) AS lrr"""
OWN = f"""SELECT *, CASE kind WHEN 'snp' THEN allele || allele WHEN 'mnv' THEN left(allele, 1) || left(allele, 1) WHEN 'insertion' THEN CASE WHEN u THEN 'II' ELSE 'DD' END ELSE CASE WHEN u THEN 'DD' ELSE 'II' END END AS genotype
  FROM (SELECT *, CASE WHEN u THEN a[CAST(1 + {_draw('pick')} % len(a) AS INTEGER)] ELSE reference END AS allele FROM (SELECT *, len(a) > 0 AND {_draw('alt')} < CAST(round(0.25 * 4294967296) AS BIGINT) AS u
  FROM ({KINDS}) AS k, (SELECT unnest(range(3)) AS file_idx) AS f) AS y) AS x"""


def _synthetic(spark, sf_dir, overlays=None):
    return synthetic.synthetic_rows(refs(spark, sf_dir), spark.range(3).select(F.col("id").alias("file_idx")), overlays, 0.25, 7)


def _specs(spark):
    return overlay.checked_specs(tables.overlay_variants(spark, text=OVERLAY_JSON))


@query(f"SELECT file_idx, rsid, chromosome, position, genotype, {METRICS} FROM ({OWN}) AS w")
def synthetic_rows(spark, sf_dir):
    return _synthetic(spark, sf_dir).drop("leftover")


@query(f"""SELECT w.file_idx, false AS leftover, w.rsid, coalesce(o.chromosome, w.chromosome) AS chromosome, coalesce(o.position, w.position) AS position,
    CASE WHEN o.rsid IS NOT NULL THEN options[CAST(1 + {_draw('option').replace('rsid', 'w.rsid')} % len(options) AS INTEGER)] ELSE genotype END AS genotype, {METRICS.replace('rsid', 'w.rsid')} FROM ({OWN}) AS w LEFT JOIN {OVERLAYS} ON o.rsid = w.rsid
  UNION ALL SELECT file_idx, true, rsid, chromosome, position, options[CAST(1 + {_draw('option')} % len(options) AS INTEGER)], {METRICS} FROM (SELECT o.*, file_idx FROM {OVERLAYS}, (SELECT unnest(range(3)) AS file_idx) AS f) AS l
  WHERE rsid NOT IN (SELECT rsid FROM ({base.REFS}) AS r)""")
def synthetic_overlay_rows(spark, sf_dir):
    return _synthetic(spark, sf_dir, _specs(spark))


def synthetic_with_overlays(spark, sf_dir):
    return _synthetic(spark, sf_dir, _specs(spark))


@query(f"SELECT unnest(range(3)) AS file_idx, (SELECT count(*) FROM ({base.REFS}) AS r) + (SELECT count(*) FROM {OVERLAYS} WHERE rsid NOT IN (SELECT rsid FROM ({base.REFS}) AS r)) AS rows")
def synthetic_file_counts(spark, sf_dir):
    return synthetic.file_counts(_synthetic(spark, sf_dir, _specs(spark)))


def _plan(stream: str, low: int, high: int) -> str:
    return f"CAST({low} + CAST('0x' || substr(md5('7:' || file_idx || '::{stream}'), 1, 8) AS BIGINT) % {high - low + 1} AS INTEGER)"


def _permuted(size: str) -> str:
    """file_idx and id, its place in the permutation, for files (file_idx) of as many ids as size says; as helixlake.functions.draws has it, by recursion."""
    mixed = "xor(l, CAST('0x' || substr(md5('7:' || round || ':' || r || ':id'), 1, 8) AS BIGINT) & (one - 1))"
    return f"""(WITH RECURSIVE n AS (SELECT {size} AS size), k AS (SELECT size, CAST(greatest(1, ceil(ceil(log2(size)) / 2)) AS INTEGER) AS half FROM n), b AS (SELECT size, CAST(pow(2, half) AS BIGINT) AS one FROM k),
    steps AS (SELECT file_idx, file_idx // one AS l, file_idx % one AS r, 0 AS round, size, one FROM files, b
      UNION ALL SELECT file_idx, CASE WHEN round = 4 THEN l ELSE r END, CASE WHEN round = 4 THEN r ELSE {mixed} END, (round + 1) % 5, size, one FROM steps WHERE round < 4 OR l * one + r >= size)
    SELECT file_idx, l * one + r AS id FROM steps WHERE round = 4 AND l * one + r < size)"""


@query(f"""WITH files AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS file_idx FROM {{customer}}), plans AS (SELECT file_idx, {_plan('month', 1, 12)} AS month, {_plan('day', 1, 28)} AS day FROM files)
SELECT f.file_idx, CAST(500 + i.id AS INTEGER) AS id, month, day, printf('out/%04d_%06d_%02d-%02d-2025_%02d_%02d_2025.txt', f.file_idx + 1, 500 + i.id, month, day, month, day) AS path, 7 + f.file_idx AS seed
  FROM plans AS f JOIN {_permuted('(SELECT 2 * count(*) - 3 FROM {customer})')} AS i ON f.file_idx = i.file_idx""")
def template_paths(spark, sf_dir):
    """A file for each customer, with distinct ids of a range that is nearly twice as large."""
    count = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return synthetic.file_plans(spark, "out/{index}_{id}_{date}_{month}_{day}_{year}.txt", count, 7, 500, 500 + 2 * count - 4)


OVERLAY_GROUPS = """SELECT s_nationkey, s_suppkey, concat('rs', CAST(s_suppkey + 7 AS VARCHAR(20))) AS rsid, CAST(s_nationkey % 22 + 1 AS VARCHAR(9)) AS chromosome, s_suppkey * 3 AS position, s_suppkey % 4 AS form FROM {supplier}"""


@query(f"""SELECT CAST(s_nationkey AS VARCHAR) AS overlay_group, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS n, s_suppkey + 7 AS rsid, chromosome, position,
  CASE form WHEN 0 THEN 'AT TT' WHEN 1 THEN 'AA AC AG CC CG GG' WHEN 2 THEN 'DD DI II' ELSE 'TT' END AS options FROM ({OVERLAY_GROUPS}) AS g""")
def overlay_expand(spark, sf_dir):
    """An overlay file with a group for each nation and a variant for each supplier: given genotypes, one or two alternates, none."""
    text = lambda x: F.array(*map(F.lit, x))
    none, form = F.lit(None).cast("array<string>"), F.col("form")
    variant = F.struct("rsid", "chromosome", "position", F.when(form == 0, text(["AT", "TT"])).otherwise(none).alias("genotypes"), F.when(form == 1, "A").when(form == 2, "I").when(form == 3, "T").alias("reference"),
                       F.when(form == 1, text(["C", "G"])).when(form == 2, text(["D"])).otherwise(none).alias("alternates"))
    groups = spark_sql(spark, sf_dir, OVERLAY_GROUPS).groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", variant.alias("v")))).alias("l"))
    entry = F.struct(F.col("s_nationkey").cast("string"), F.struct(F.transform("l", lambda x: x["v"]).alias("variants")))
    path = f"{storage.new_path(spark, 'query')}/overlay.json"
    storage.write_text_file(groups.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select(F.to_json("m").alias("line")), path)
    return overlay.checked_specs(tables.overlay_variants(spark, path)).select(F.col("group").alias("overlay_group"), "n", "rsid", "chromosome", "position", F.array_join("options", " ").alias("options"))


FAULTY = """SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN concat('x', CAST(s_suppkey AS VARCHAR(20))) WHEN s_suppkey % 7 = 0 THEN 'rs7' ELSE concat('rs', CAST(s_suppkey + 1000 AS VARCHAR(20))) END AS rsid, s_suppkey % 5 AS form FROM {supplier}"""


@query(f"""SELECT CAST(s_nationkey AS VARCHAR) AS overlay_group, n, CASE WHEN rsid LIKE 'x%' THEN 'no valid rsid: ' || rsid WHEN form = 1 THEN 'no genotypes given for ' || rsid WHEN form = 2 THEN 'neither genotypes nor a reference for ' || rsid ELSE 'given more than once: ' || rsid END AS problem
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS n, count(*) OVER (PARTITION BY rsid) AS times FROM ({FAULTY}) AS f) AS g WHERE rsid LIKE 'x%' OR form IN (1, 2) OR times > 1""")
def overlay_problems(spark, sf_dir):
    """Which variants of an overlay would be refused, and why."""
    form, none = F.col("form"), F.lit(None).cast("array<string>")
    rows = spark_sql(spark, sf_dir, FAULTY).select(F.col("s_nationkey").cast("string").alias("group"), "s_suppkey", "rsid", F.when(form == 1, F.array().cast("array<string>")).when(form == 3, F.array(F.lit("AA"))).otherwise(none).alias("genotypes"),
                                                   F.when(form.isin(0, 4), "A").alias("reference"))
    n = (F.row_number().over(Window.partitionBy("group").orderBy("s_suppkey")) - 1).cast("int")
    return overlay.overlay_problems(rows.withColumn("n", n)).select(F.col("group").alias("overlay_group"), "n", "problem")

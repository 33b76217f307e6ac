"""Command line: genostats, reference-load, allele-report, synthetic, extract, generate, diff."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from helixlake import session, shared_files, storage
from helixlake.operators import diff, lookup, overlay, store, summary, synthetic
from helixlake.sinks import genotype_files, reports
from helixlake.sources import bgzf, files, genotype_text, tables


def needed(spark, *paths):
    """Inputs must be there, on whatever file system."""
    for path in paths:
        if not storage.exists(spark, path):
            raise FileNotFoundError(path)


def genostats(spark, a):
    paths, failures = files.split_failures(spark, files.discover(spark, a.input, a.max_files))
    kept = store.Store(spark, a.sqlite)
    if a.skip_recorded_files:
        names = spark.createDataFrame([(files.metadata_name(spark, p), p) for p in paths], "file_path string, path string")
        paths = sorted(r["path"] for r in kept.unrecorded(names).collect())
    stats = None
    if paths:
        stats = genotype_text.file_stats(genotype_text.read_genotypes(spark, paths))
        kept.record_files(stats)
        stats = kept.read("manifest")
    for r in failures.collect():
        print(f"failed: {r['file_path']}: {r['error']}")
    report = summary.summary(kept.read("formats"), kept.read("references"), str(a.sqlite), stats if a.mode == "observed" else None)
    row = report.first()
    print(f"{row['files_processed']} files, {row['total_variants']} variants, {row['skipped_rows']} skipped rows; store at {a.sqlite}")
    if a.summary_json:
        reports.write_summary_json(a.summary_json, report)


def reference_load(spark, a):
    needed(spark, a.lookup)
    counts = store.Store(spark, a.sqlite).load_lookup(tables.read_lookup_csv(spark, a.lookup))
    print(f"imported {counts['imported']} rows, skipped {counts['skipped']}")


def allele_report(spark, a):
    kept = store.Store(spark, a.sqlite, create=False)
    counts = summary.coverage_summary(kept.read("references")).first().asDict()
    reports.write_html_report(a.output, summary.coverage_rows(kept.read("formats"), kept.read("references")), counts, str(a.sqlite))


def make_synthetic(spark, a):
    synthetic.check_arguments(a.output, a.count, a.alt_frequency, a.id_min, a.id_max, a.month_min, a.month_max, a.day_min, a.day_max)
    references = store.ordered_references(store.Store(spark, a.sqlite, create=False).read("references"), a.limit)
    if references.isEmpty():
        raise ValueError("the store has no references")
    seed = synthetic.random_seed() if a.seed is None else a.seed
    specs = overlay.checked_specs(tables.overlay_variants(spark, a.variants_file, a.variants_json)) if a.variants_file or a.variants_json else None
    plans = synthetic.file_plans(spark, a.output, a.count, seed, a.id_min, a.id_max, a.date_year, a.month_min, a.month_max, a.day_min, a.day_max, a.date_format)
    written = genotype_files.write_genotype_files(synthetic.synthetic_rows(references, plans, specs, a.alt_frequency, seed), plans)
    total = written.agg(F.count(F.lit(1)), F.sum("rows")).first()
    print(f"{total[0]} files, {total[1]} rows, alternate frequency {a.alt_frequency * 100:.2f} %")


def extract(spark, a):
    needed(spark, a.input, a.vcf)
    rows = tables.marker_rows(genotype_text.read_lines(spark, [a.input]), a.limit)
    # What the queries cannot meet is not read, but every contig of the file is known.
    if tables.is_blocked(a.vcf) and shared_files.exists(f"{a.vcf}.tbi"):
        vcf = tables.read_vcf_blocks(spark, a.vcf, lookup.wanted_regions(rows, a.window))
        contigs = dict.fromkeys(tables.declared_contigs(tables.header_of(spark, a.vcf)) + bgzf.Index.read(f"{a.vcf}.tbi").names)
        known = spark.createDataFrame([(c,) for c in contigs], "contig string")
    else:
        path = a.vcf
        if not tables.is_converted(spark, path):
            path = storage.new_path(spark, "vcf")
            tables.vcf_to_parquet(spark, [a.vcf], path)
        vcf, known = lookup.prune_records(tables.read_vcf(spark, path), rows, a.window), tables.vcf_contigs(spark, path).select("contig")
    found = lookup.find_records(rows, vcf, a.window, known=known)
    counts = reports.write_routed_csv(lookup.lookup_rows(found, "line_no"), a.output, a.missing_output, ["line_no"])
    print(f"{counts['exact']} exact rows to {a.output}, {counts['other']} others to {a.missing_output}")


def generate(spark, a):
    needed(spark, a.lookup)
    synthetic.check_arguments(a.output, alt_frequency=a.alt_frequency)
    rows = tables.exact_rows(tables.read_lookup_csv(spark, a.lookup))
    seed = synthetic.random_seed() if a.seed is None else a.seed
    made = synthetic.generated_rows(rows, spark.createDataFrame([(0,)], "file_idx long"), a.alt_frequency, seed)
    genotype_files.write_generated_file(made, a.output)
    print(f"{rows.count()} rows to {a.output}")


def compare(spark, a):
    needed(spark, a.baseline, a.candidate)
    sides = [tables.genotype_map(genotype_text.read_lines(spark, [p])) for p in (a.baseline, a.candidate)]
    print(reports.diff_report(diff.compare(*sides), a.max_diffs))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixlake", description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(name, function, *options):
        c = commands.add_parser(name)
        c.set_defaults(run=function)
        for flags, settings in options:
            c.add_argument(*flags.split(), **settings)

    kept = ("--sqlite", {"default": "data/genostats", "help": "folder of the store"})
    number = lambda flag, default=None: (flag, {"type": int, "default": default})
    needed = lambda flag: (flag, {"required": True})
    threads = number("--threads")
    command("genostats", genostats, ("-i --input", {"action": "append", "default": []}), kept, ("--summary-json", {}), number("--max-files"), ("--skip-recorded-files", {"action": "store_true"}), threads,
            ("--mode", {"choices": ["parity", "observed"], "default": "observed"}))
    command("reference-load", reference_load, kept, needed("--lookup"))
    command("allele-report", allele_report, kept, needed("--output"))
    frequency, seed = ("--alt-frequency", {"type": float, "default": 0.01}), number("--seed")
    command("synthetic", make_synthetic, kept, needed("--output"), frequency, seed, number("--limit"), number("--count", 1), threads, ("--variants-file", {}), ("--variants-json", {}), number("--id-min", 100_000),
            number("--id-max", 999_999), number("--date-year", 2025), number("--month-min", 1), number("--month-max", 12), number("--day-min", 1), number("--day-max", 28), ("--date-format", {"default": "%m-%d-%Y"}))
    command("extract", extract, needed("--input"), needed("--vcf"), needed("--output"), needed("--missing-output"), number("--limit"), number("--window", 0))
    command("generate", generate, needed("--lookup"), needed("--output"), frequency, seed)
    command("diff", compare, ("baseline", {}), ("candidate", {}), number("--max-diffs", 20))
    return p


def main(arguments: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or session.build()
    session.ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()

"""Schemas of stored and exchanged tables."""

from __future__ import annotations

FORMATS = "id BIGINT NOT NULL, name STRING NOT NULL, genome_build STRING"
REFERENCES = "rsid BIGINT NOT NULL, format_id BIGINT NOT NULL, chromosome STRING NOT NULL, position BIGINT NOT NULL, reference STRING NOT NULL, alternates STRING NOT NULL"
MANIFEST = "file_path STRING, variant_count BIGINT, skipped_rows BIGINT"
LOOKUP_COLUMNS = ["query_rsid", "query_chrom", "query_pos", "ref_contig", "ref_pos", "ref", "alt", "filters", "status"]
LOOKUP_NEEDED = ["query_rsid", "query_chrom", "query_pos", "ref_pos", "ref", "alt", "status"]
OVERLAY = "MAP<STRING, STRUCT<variants: ARRAY<STRUCT<rsid: STRING, chromosome: STRING, position: BIGINT, genotypes: ARRAY<STRING>, reference: STRING, alternates: ARRAY<STRING>>>>>"
VCF = "contig STRING, pos BIGINT, id STRING, ref STRING, alts ARRAY<STRING>, filters ARRAY<STRING>, info_rs ARRAY<BIGINT>, stop BIGINT, file_order BIGINT"
#: A converted table, in folders by contig and level of bins, and what is known of its contigs.
VCF_TABLE = f"{VCF}, level INT"
VCF_CONTIGS = "contig STRING, records BIGINT, longest BIGINT, least BIGINT, most BIGINT, declared BOOLEAN"
#: The format that a new store holds.
DEFAULT_FORMAT = (1, "dynamic_dna", "GRCh38")
GENOTYPE_COLUMNS = ["rsid", "chromosome", "position", "genotype", "gs", "baf", "lrr"]

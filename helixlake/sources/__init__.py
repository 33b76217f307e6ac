"""Readers: files, genotype text, lookup CSV, VCF text, overlays."""

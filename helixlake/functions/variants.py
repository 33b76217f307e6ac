"""Kinds of variants, and genotypes made from alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.functions.text import trim


def split_alternates(c: Column) -> Column:
    """Non-empty alternates of a comma list, trimmed."""
    return F.filter(F.transform(F.split(c, ",", -1), trim), lambda x: x != "")


def variant_kind(reference: Column, alternates: Column) -> Column:
    """snp, mnv, insertion or deletion; lengths in bytes, mixed lengths go by the first alternate."""
    size, first = F.octet_length(reference), F.octet_length(F.get(alternates, F.lit(0)))
    every = lambda n: F.forall(alternates, lambda x: F.octet_length(x) == n)
    return (F.when((F.size(alternates) == 0) | ((size == 1) & every(F.lit(1))), "snp").when((size > 1) & every(size), "mnv")
            .when(first > size, "insertion").when(first < size, "deletion").otherwise("mnv"))


def first_symbol(c: Column) -> Column:
    return F.when(c == "", "?").otherwise(F.substring(c, 1, 1))


def genotype_combinations(reference: Column, alternates: Column) -> Column:
    """All pairs, with repetition, of the sorted distinct alleles; an empty reference counts, empty alternates do not."""
    alleles = F.array_sort(F.array_distinct(F.concat(F.array(reference), F.filter(alternates, lambda x: x != ""))))
    return F.flatten(F.transform(alleles, lambda a, i: F.transform(F.slice(alleles, i + 1, F.size(alleles) - i), lambda b: F.concat(a, b))))


def synthesize_genotype(reference: Column, alternates: Column, use_alternate: Column, pick: Column) -> Column:
    """A homozygous genotype: the alternate numbered pick (from 0) where use_alternate holds and there is one.

    snp: the allele twice; mnv: its first symbol twice; insertion: II or DD; deletion: DD or II.
    """
    use = use_alternate & (F.size(alternates) > 0)
    allele = F.when(use, F.get(alternates, pick.cast("int"))).otherwise(reference)
    kind = variant_kind(reference, alternates)
    return (F.when(kind == "snp", F.concat(allele, allele)).when(kind == "mnv", F.repeat(first_symbol(allele), F.lit(2)))
            .when((kind == "insertion") == use, "II").otherwise("DD"))

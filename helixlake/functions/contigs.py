"""Chromosome names and the contigs of the reference assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accessions of the human reference assembly, build 38.
CONTIGS = {
    "1": "NC_000001.11", "2": "NC_000002.12", "3": "NC_000003.12", "4": "NC_000004.12", "5": "NC_000005.10", "6": "NC_000006.12",
    "7": "NC_000007.14", "8": "NC_000008.11", "9": "NC_000009.12", "10": "NC_000010.11", "11": "NC_000011.10", "12": "NC_000012.12",
    "13": "NC_000013.11", "14": "NC_000014.9", "15": "NC_000015.10", "16": "NC_000016.10", "17": "NC_000017.11", "18": "NC_000018.10",
    "19": "NC_000019.10", "20": "NC_000020.11", "21": "NC_000021.9", "22": "NC_000022.11", "X": "NC_000023.11", "Y": "NC_000024.10",
    "M": "NC_012920.1", "MT": "NC_012920.1",
}


def contig_of(chromosome: Column) -> Column:
    """The contig of a chromosome name, with or without one CHR before it, in any case; else null."""
    from helixlake.functions.text import trim

    names = F.create_map(*[F.lit(x) for pair in CONTIGS.items() for x in pair])
    return F.try_element_at(names, F.regexp_replace(F.upper(trim(chromosome)), "^CHR", ""))

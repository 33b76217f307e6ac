"""Writers: genotype files, reports, routed CSV."""

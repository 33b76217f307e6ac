"""A PySpark-native toolkit for genotype files and large text corpora."""

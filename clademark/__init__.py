"""Cohort-scale resistance genotyping as Spark DataFrame operators."""

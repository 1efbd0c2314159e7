"""cohortloom: DNA-methylation cohort analytics as PySpark DataFrame jobs.

Measurements are one long table, one row per (sample, probe).  Every function
takes and returns DataFrames, so a caller composes them and Catalyst plans the
whole chain at once.
"""

"""Repeated-observation panels on Spark: assemble, label, audit, split, score and rank."""

"""Tabulon: a Spark-first engine for particle tables, their statistics, samplers and streams."""

"""Checks, controls, change-data replay, fault injection and scoring for data pipelines, as Spark plans."""

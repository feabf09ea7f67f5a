"""Detectors, fixes, candidates, evaluation and curation over DataFrames."""

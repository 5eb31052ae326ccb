"""Whole jobs composed of the operators: ingest, retrieval, answers, evaluation."""

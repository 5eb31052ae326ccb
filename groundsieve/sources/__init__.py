"""Readers and writers: corpora, question sets, indexes, run artifacts."""

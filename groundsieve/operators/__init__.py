"""DataFrame operators: splitting, indexing, search, fusion, evidence, answers, evaluation."""

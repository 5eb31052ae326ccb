"""Column functions: text, spans, vectors, ranked lists, model output."""

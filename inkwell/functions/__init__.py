"""Column functions: text, decisions, vocabularies and model output."""

"""Column-level building blocks: text, JSON, answers and tokens."""

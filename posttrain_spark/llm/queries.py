"""Registers the queries of the operators in this subpackage."""

from importlib import import_module

MODULES = ("jaccard_join", "bpe", "mixing", "toxicity", "line_dedup", "quality", "html_text", "warc", "secret_scan", "bm25", "exact_dedup", "merkle", "prefix_trie")


def load() -> None:
    for name in MODULES:
        import_module(f"posttrain_spark.llm.{name}")

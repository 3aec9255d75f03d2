"""Queries over the given tables, one per operator, each with its SQL twin where SQL can say it."""

from importlib import import_module

MODULES = ("checks", "rewards", "chat", "datasets", "answers", "evaluation", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"posttrain_spark.plans.{name}")

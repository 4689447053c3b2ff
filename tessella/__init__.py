"""Spark-native reversible data transforms."""

from tessella.errors import ConfigNotSetError, InvalidConfigError, InvalidDataError, NotFittedError, TransformerInputError, TransformerProcessingError
from tessella.functions.watch import Watch
from tessella.plans.registry import *  # noqa: F403
from tessella.plans.table import Config, HyperTransformer
from tessella.sources.demo import get_demo

__all__ = ["Config", "ConfigNotSetError", "HyperTransformer", "InvalidConfigError", "InvalidDataError", "NotFittedError", "TransformerInputError", "TransformerProcessingError", "Watch", "get_demo"]

"""Imports every query module so the registry is complete."""

from taffeta.plans import analysis, corpus, distributions, events, io, tokens  # noqa: F401
from taffeta.plans.registry import ORACLES, QUERIES  # noqa: F401
from taffeta.session import ensure_checkpoint_dir


def prepare(spark):
    ensure_checkpoint_dir(spark)

"""All registered queries."""

from acceptance import evaluation, labelling, modelling, reviewing, sources  # noqa: F401
from acceptance.registry import CHECKS

__all__ = ["CHECKS"]

"""Preprocessing pipelines: their specification and their compilation to column expressions."""

from .pipeline import Pipeline
from .spec import PipelineSpec, builtin, builtin_names, stop_list

__all__ = ["Pipeline", "PipelineSpec", "builtin", "builtin_names", "stop_list"]

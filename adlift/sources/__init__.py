"""Sources (the nine input tables), fixtures and the extract cache."""

from .cache import missing_extracts, read_extracts, rejected_records, write_extracts
from .fixtures import FIXTURE_CTES, fixture_frames, fixture_sources, oracle
from .fold import FoldStore, daily_fold
from .manifest import ReplayRefused, manifest_table
from .registry import Sources
from .schemas import EXTRACT_NAMES, SOURCE_SCHEMAS, extract_schemas

__all__ = [
    "EXTRACT_NAMES",
    "FIXTURE_CTES",
    "FoldStore",
    "ReplayRefused",
    "SOURCE_SCHEMAS",
    "Sources",
    "daily_fold",
    "extract_schemas",
    "fixture_frames",
    "fixture_sources",
    "manifest_table",
    "missing_extracts",
    "oracle",
    "read_extracts",
    "rejected_records",
    "write_extracts",
]

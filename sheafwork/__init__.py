"""Context assembly on Spark: resolve selection requests against a catalog and bundle the files."""

from sheafwork.plans.assembly import Assembly, assemble
from sheafwork.operators.aliases import resolve_aliases, with_aliases
from sheafwork.operators.cascade import Resolution, resolve
from sheafwork.session import build_session
from sheafwork.sources.files import file_catalog, file_contents
from sheafwork.sources.sinks import write_bundles
from sheafwork.sources.tables import request_batch, table_catalog

__all__ = [
    "Assembly",
    "Resolution",
    "assemble",
    "build_session",
    "file_catalog",
    "file_contents",
    "request_batch",
    "resolve",
    "resolve_aliases",
    "table_catalog",
    "with_aliases",
    "write_bundles",
]

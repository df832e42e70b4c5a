"""DuckDB checks for the registered queries, written over the same notebook views."""

from . import change_sets, core, documents, files, lifecycle, outcomes, retrieval, writes

ORACLES: dict[str, str] = {}
for module in (core, outcomes, retrieval, writes, lifecycle, change_sets, documents, files):
    ORACLES.update(module.QUERIES)

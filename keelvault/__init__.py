"""Keelvault: a Spark-native engine that loads Data Vault 2 tables as lazy DataFrames."""

from .config import VaultConfig
from .operators.ghosts import ghost_records
from .operators.keyed import hub, link
from .operators.satellite import end_dated_delta, satellite, satellite_end_dated
from .operators.stage import stage
from .sources.committed import CommittedTable
from .sources.end_dated import EndDatedTable
from .sources.tables import TableRef, append, read_table
from .specs import Binding, HashRule, Kept, StageSpec

__all__ = ["Binding", "CommittedTable", "EndDatedTable", "HashRule", "Kept", "StageSpec", "TableRef", "VaultConfig", "append", "end_dated_delta", "ghost_records", "hub", "link", "read_table", "satellite", "satellite_end_dated", "stage"]

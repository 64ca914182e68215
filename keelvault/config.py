"""Settings of a vault: an immutable value that is passed to each operator, with no global state."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields, replace
from pathlib import Path

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class VaultConfig:
    """Names of the standard columns, sentinel dates, hashing rules and record sources of ghost rows.

    quote_identifiers concerns table names given as parts (TableRef).
    """

    end_of_all_times: str = "9999-12-31"
    beginning_of_all_times: str = "0001-01-01"
    ldts_alias: str = "ldts"
    rsrc_alias: str = "rsrc"
    ledts_alias: str = "ledts"
    hash: str = "MD5"
    hashkey_input_case_sensitive: bool = False
    hashdiff_input_case_sensitive: bool = False
    use_trim: bool = True
    empty_as_null: bool = False
    quote_identifiers: bool = True
    ghost_record_rsrc: str = "SYSTEM"
    ghost_record_error_rsrc: str = "ERROR"

    def with_settings(self, **settings: object) -> VaultConfig:
        """A copy with other settings; unknown ones are logged and left out."""
        known = {f.name for f in fields(self)}
        for name in settings.keys() - known:
            log.warning("unknown setting %r is ignored", name)
        return replace(self, **{k: v for k, v in settings.items() if k in known})

    @classmethod
    def from_json(cls, path: str | Path = "config.json") -> VaultConfig:
        """The settings in a JSON file; the defaults where there is none or it can't be read (which is logged)."""
        file = Path(path)
        if not file.is_file():
            return cls()
        try:
            found = json.loads(file.read_text(encoding="utf-8"))
            return cls().with_settings(**found)
        except (OSError, ValueError, TypeError) as error:
            log.error("settings in %s can't be read: %s", file, error)
            return cls()

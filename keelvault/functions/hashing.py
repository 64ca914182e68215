"""Hash keys and hash diffs as built-in column expressions, so that they stay inside generated code."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import VaultConfig

log = logging.getLogger(__name__)

#: What stands for a NULL, what protects it in data, the delimiter, and the characters that are removed.
NULL_MARK, NULL_MARK_IN_DATA, DELIMITER, REMOVED = "^^", "--", "||", "\t\n\x0b\r"


def algorithm(name: str) -> str:
    """md5, sha1 or sha256; anything else is taken as md5, with a warning."""
    upper = name.upper().replace("-", "").replace("_", "")
    if upper in ("SHA256", "SHA2"):
        return "sha256"
    if upper in ("SHA1", "SHA"):
        return "sha1"
    if upper != "MD5":
        log.warning("unknown hash algorithm %r: MD5 is used", name)
    return "md5"


def key_length(name: str) -> int:
    return {"md5": 32, "sha1": 40, "sha256": 64}[algorithm(name)]


def zero_key(name: str) -> str:
    """The key of an all-NULL input and of the unknown ghost."""
    return "0" * key_length(name)


def error_key(name: str) -> str:
    """The key of the error ghost."""
    return "f" * key_length(name)


def cleaned(column: Column, trim: bool, empty_as_null: bool = False) -> Column:
    """One hash input as quoted text, with the NULL mark for NULL."""
    text = column.cast("string")
    text = F.trim(text) if trim else text
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(NULL_MARK), F.lit(NULL_MARK_IN_DATA))
    text = F.concat(F.lit('"'), text, F.lit('"'))
    if empty_as_null:
        text = F.nullif(text, F.lit('""'))
    return F.coalesce(text, F.lit(NULL_MARK))


def hash_expr(columns: Sequence[str | Column], cfg: VaultConfig | None = None, *, is_hashdiff: bool = False, case_sensitive: bool | None = None, trim: bool | None = None) -> Column:
    """The hash of the columns, in lower-case hex; None takes the setting."""
    cfg = cfg or VaultConfig()
    if not columns:
        raise ValueError("a hash needs at least one column")
    if case_sensitive is None:
        case_sensitive = cfg.hashdiff_input_case_sensitive if is_hashdiff else cfg.hashkey_input_case_sensitive
    trim = cfg.use_trim if trim is None else trim
    inputs = [F.col(_quoted(c)) if isinstance(c, str) else c for c in columns]
    joined = F.concat_ws(DELIMITER, *[cleaned(c, trim, cfg.empty_as_null) for c in inputs])
    joined = joined if case_sensitive else F.upper(joined)
    joined = F.nullif(F.translate(joined, REMOVED, ""), F.lit(DELIMITER.join([NULL_MARK] * len(inputs))))
    kind = algorithm(cfg.hash)
    digest = F.sha2(joined, 256) if kind == "sha256" else F.sha1(joined) if kind == "sha1" else F.md5(joined)
    return F.coalesce(digest, F.lit(zero_key(cfg.hash)))


def packed(key: Column) -> Column:
    """A key as bytes, so that fewer are shuffled and sorted: lower-case hex as what it says, any other text as it is."""
    given = F.unhex(key)
    return F.when(F.lower(F.hex(given)) == key, F.concat(F.lit(b"\x00"), given)).otherwise(F.concat(F.lit(b"\x01"), key.cast("binary")))


def unpacked(key: Column) -> Column:
    """The text of a packed key."""
    rest = F.substring(key, 2, 1 << 30)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"

"""A whole load, from a raw table to an end-dated satellite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import VaultConfig
from ..operators.keyed import hub, link
from ..operators.satellite import satellite, satellite_end_dated
from ..operators.stage import stage
from ..specs import Binding, StageSpec


@dataclass(frozen=True)
class VaultLoad:
    """The relations of one load, all lazy."""

    staged: DataFrame
    hub: DataFrame
    link: DataFrame
    satellite: DataFrame
    end_dated: DataFrame


def load_vault(spec: StageSpec, *, hash_key: str, business_keys: list[str], link_key: str, foreign_keys: list[str], hash_diff: str, payload: list[str], stage_to: str | None = None, cfg: VaultConfig | None = None) -> VaultLoad:
    """Initial load of a hub, a link and a satellite from one raw table.

    stage_to: a path at which the staged rows are written, at once, as Parquet; the entities then read what they need of it,
    and nothing is hashed more than once.  Without it the stage is a view that each entity evaluates for itself.
    """
    cfg = cfg or VaultConfig()
    staged = stage(spec, cfg=cfg)
    if stage_to:
        staged.write.mode("overwrite").parquet(stage_to)
        staged = staged.sparkSession.read.schema(staged.schema).parquet(stage_to)
    source = Binding(staged)
    history = satellite(source, hash_key, hash_diff, payload=payload, cfg=cfg)
    return VaultLoad(staged, hub([source], hash_key, business_keys, cfg=cfg), link([source], link_key, foreign_keys, cfg=cfg), history, satellite_end_dated(history, hash_key, cfg=cfg))

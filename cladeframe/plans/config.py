"""Settings of a run, read from a flat JSON object."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    """Unknown keys of a file are kept in ``other``.  ``plans.run`` says what a run reads."""

    clustering_scheme: str = "ehac"
    linkage: str = "average"
    model: str = ""
    pair_model: str = "base"
    merge_model: str = "base_sub_ent"
    nn_k: int = 10
    nsw_r: int = 5
    exact_nn: bool = False
    rotate: bool = True
    graft: bool = True
    graft_beam: int = 5
    max_node_graft_size: int | None = None
    max_node_rotate_size: int | None = None
    max_num_samples: int = 25
    best_pair_budget: int = 100
    sample_pairs: bool = False
    random_order: bool = False
    skip_unlabeled: bool = False
    mini_batch: int = 1000
    expit_e_score: bool = False
    train_tree_size: int = 20
    max_dev_canopy_size: int = 100
    partition_threshold: float = 0.0
    seed: int = 1451
    other: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> "Config":
        with open(path, encoding="utf-8") as f:
            return Config.of(json.load(f))

    @staticmethod
    def of(values: dict) -> "Config":
        names = {x.name for x in fields(Config)} - {"other"}
        return Config(**{k: v for k, v in values.items() if k in names}, other={k: v for k, v in values.items() if k not in names})

    def json(self) -> str:
        d = asdict(self)
        return json.dumps(d.pop("other") | d, sort_keys=True, indent=1)

    def grid(self, **choices: list) -> list["Config"]:
        """One setting for each combination of the choices."""
        out = [self]
        for name, values in choices.items():
            out = [replace(c, **{name: v}) for c in out for v in values]
        return out

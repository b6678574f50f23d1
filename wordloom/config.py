"""Settings of training and of prediction, as dataclasses that JSON files hold."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


class Settings:
    """Keys that a class lacks are ignored when read; those that a file lacks keep their defaults."""

    @classmethod
    def from_json(cls, text: str):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, ensure_ascii=False, sort_keys=True)


@dataclass
class Training(Settings):
    """How a model is trained. least: counts below which n-grams of each order go, for by-count pruning."""

    order: int = 4
    lowered_from: float = 0.35
    respelled_from: float = 1e-8
    unknown_to: int = 0
    valid_from: int = 20
    discount: float | None = None
    discount_low: float = 0.1
    discount_high: float = 0.9
    #: none, raw_count, order_count, difference or raw_difference
    pruning: str = "none"
    raw_count: int = 2
    least: list[int] = field(default_factory=lambda: [-1, 2, 3, 4])
    difference: float = 0.0
    lexicon: str | None = None
    stop_words: str | None = None
    semantic_rank: int = 100
    semantic_columns: int = 5000
    semantic_rows: int = 80_000
    density_neighbours: int = 200
    semantic_window: int = 100


@dataclass
class Prediction(Settings):
    """How words are predicted."""

    wanted: int = 5
    add_new_words: bool = True
    least_uses: int = 10
    dynamic: bool = True
    least_typed: int = 0
    least_typed_corrected: int = 0
    dynamic_least_weight: float = 0.05
    correction: bool = False
    most_cost: float = 3.5
    default_factor: float = 0.5
    default_cost: float = 1.0
    debug: bool = False
    custom: dict[str, str] = field(default_factory=dict)

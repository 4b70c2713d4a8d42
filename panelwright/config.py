"""Fixed values of the panel analysis; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelConfig:
    pre: tuple[str, ...] = ("2023Q1", "2023Q2", "2023Q3", "2023Q4", "2024Q1")
    shock_start: str = "2024Q2"
    end: str = "2026Q3"
    min_link_items: int = 3
    lags: tuple[int, ...] = (0, 1, 2, 3)
    roast_loss: float = 0.18
    roast_losses: tuple[float, ...] = (0.15, 0.18, 0.20)
    min_cost_change: float = 10.0
    min_products: int = 5
    min_obs: int = 20
    z95: float = 1.959964
    sale_drop: float = 0.90
    sale_revert: float = 0.95
    id_break_below: float = 0.10
    bundle_ratio: float = 1.75
    min_similarity: float = 0.5
    top_k: int = 3
    price_move: float = 0.005
    big_drop: float = 0.5


CONFIG = PanelConfig()

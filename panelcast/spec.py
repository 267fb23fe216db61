"""Declarative description of a panel: which column plays which role."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """Roles of the columns of a panel DataFrame.

    unit     -- cross-sectional unit (state)
    period   -- time index (year)
    item     -- policy / bill key; the grouping for leave-one-item-out folds
    label    -- 0/1 "adopted in this period"
    features -- numeric covariates
    cluster  -- cluster key for robust covariance (optional)
    row_key  -- unique, stable row identifier (used for hash-ordered splits)
    """

    label: str
    features: tuple[str, ...]
    unit: str | None = None
    period: str | None = None
    item: str | None = None
    cluster: str | None = None
    row_key: str | None = None
    categorical: tuple[str, ...] = field(default_factory=tuple)

    def ids(self) -> list[str]:
        return [c for c in (self.row_key, self.unit, self.item, self.period, self.cluster) if c]

    def columns(self) -> list[str]:
        seen: list[str] = []
        for c in [*self.ids(), self.label, *self.categorical, *self.features]:
            if c and c not in seen:
                seen.append(c)
        return seen

    def with_features(self, features) -> "PanelSpec":
        return PanelSpec(self.label, tuple(features), self.unit, self.period, self.item,
                         self.cluster, self.row_key, self.categorical)

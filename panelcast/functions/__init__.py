"""Column helpers and small numeric functions used by the operators."""

from panelcast.functions.columns import rnd

__all__ = ["rnd"]

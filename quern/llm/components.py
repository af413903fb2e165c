"""Connected components, which the engine and the training-data operators share."""

from quern.components import connected_components

__all__ = ["connected_components"]

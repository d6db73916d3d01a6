"""partcast: parts-demand analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` transformation (or a small
composition of them); nothing iterates over items on the driver.
"""

from partcast.params import Params, EVENTS_PARAMS

__all__ = ["Params", "EVENTS_PARAMS"]

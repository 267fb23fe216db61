"""panelcast: event-history / policy-adoption panel analytics on Spark.

A panel is a DataFrame with one row per (unit, item, period) at risk and a
0/1 label "adopted now".  The package provides the cleaning, encoding,
scaling, fold, model, metric, significance and cascade operators that an
adoption-forecasting study runs, each as a Spark plan.
"""

import sys

from pyspark import cloudpickle

from panelcast.spec import PanelSpec

# Task functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PanelSpec"]

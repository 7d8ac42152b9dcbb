"""Section-series analytics as DataFrame operators.

A stack of two-dimensional sections is a table ``pixels(z, x, y, v)`` and a
position estimate is a table ``lut(bx, by, z, c)``.  Every operator takes and
returns DataFrames; SQL NULL is the only missing value.
"""

import sys

from pyspark import cloudpickle

from sectionflow.functions.grid import Grid
from sectionflow.session import configure, materialize

# Functions that run in tasks travel with the job instead of being imported by
# the workers, so that nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid", "configure", "materialize"]

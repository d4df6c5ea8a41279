"""transcriba: a Spark-first analytics engine for transcribed media and text collections."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""millrace: catalogue, quotation and matching analytics as Spark DataFrame jobs.

Python functions that run inside tasks are pickled by reference where the
workers can import this package, and by value otherwise (a notebook or a
driver started elsewhere), so no job depends on the working directory.
"""

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parent.parent)


def _workers_can_import() -> bool:
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any(os.path.abspath(p) == _ROOT for p in paths)


if not _workers_can_import():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

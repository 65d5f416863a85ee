"""Operators for building training corpora. Nothing outside this subpackage imports it.

Functions sent to executors carry their code with them, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

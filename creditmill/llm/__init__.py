"""Operators for preparing text corpora: filtering, de-duplication, packing, encoding, archives.

Functions that run in tasks travel with them, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

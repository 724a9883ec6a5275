"""Operations on training text: deduplication, scoring, formatting and packing.

Task code is shipped by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

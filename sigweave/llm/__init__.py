"""Training-data operators. Nothing else in sigweave imports this subpackage.

Python workers get its functions by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

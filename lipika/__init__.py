"""Text normalisation and speech-corpus analytics as Spark column expressions and DataFrame operators.

Functions that run on executors are sent by value, so Python workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: mixing, fingerprints, search, extraction, privacy, packing, dedup, scoring, toxicity.

Nothing outside this subpackage imports it. Functions sent to executors are pickled by value, so workers need not
have the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

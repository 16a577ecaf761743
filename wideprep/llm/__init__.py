"""Training-data operators: PII, packing, nearest neighbours, language id, token counts, sharding, near-duplicates,
licence scans, toxicity, benchmark decontamination.

Task code is pickled by value, so executors need nothing of this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing language-model training data (LM scoring, quality
classifier, packing, line dedup, language id, mixing, fingerprints, embedding
near-dedup, n-gram Jaccard join, secret scans).

Nothing else in the library imports this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# ship the package's worker-side code with the tasks (executors need not have it installed)
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Source-code audits over tables: scan rules, ordered edits, diff review, roll-ups.

Everything is a DataFrame transformation.  Two jobs need Python workers (syntax
facts and diff text); the worker functions are shipped to the executors by
value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

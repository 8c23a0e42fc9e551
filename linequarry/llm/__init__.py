"""Operators for preparing training text: scoring, filtering, deduplication, mixing.

Nothing outside this subpackage imports it.  Functions that run on executors
travel with their closures (pickled by value), so a cluster does not need the
package installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""gatewatch: login-audit analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
``Column`` builder) so that Catalyst sees one declarative plan per query.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so a cluster's
# workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

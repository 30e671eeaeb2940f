"""Operators for preparing training text: filters, joins, scores and packing.

Nothing else in the library imports this package.  The Python functions that
run in tasks travel with the job, so executors need not have it installed.
"""

from pyspark import cloudpickle

import candlewick

cloudpickle.register_pickle_by_value(candlewick)

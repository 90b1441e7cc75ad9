"""Training-data operators: tokenising, quality, deduplication, licences, language, pages, chat, shards."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run in tasks travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

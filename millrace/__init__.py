"""millrace: curation, scoring and triage of large text corpora on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

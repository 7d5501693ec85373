"""Training-data operators.  Nothing else in the library imports this subpackage.

The helper modules are pickled by value, so that executors need no copy of the
repository on their Python path.
"""

import importlib

from pyspark import cloudpickle

for _name in ("common", "blocks", "collocations", "katz", "language_id", "near_dedup", "packing", "secrets", "substring_dedup", "suffix_dedup", "whitening"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))

"""Training-data operators. Nothing else in the library imports this subpackage.

The modules are pickled by value, so executors need no copy of the package.
"""

import importlib
import pkgutil

from pyspark import cloudpickle

for _found in pkgutil.iter_modules(__path__):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_found.name}"))

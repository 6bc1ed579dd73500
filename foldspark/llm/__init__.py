"""Training-data pipeline operators: archives, URL rules, near-duplicates, scoring, mixing.

Nothing else in the library imports this subpackage. Its Python workers receive
the functions by value, so executors need no installed copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

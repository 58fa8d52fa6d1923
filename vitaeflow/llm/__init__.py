"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# tasks get this subpackage's functions with their code, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Reduce sequence collections to a small, diverse subset with Spark DataFrames.

Functions that run in Python workers travel with their tasks, so executors
need no copy of this package.
"""

from pyspark import cloudpickle

from seqthin.functions import calibrate, kernels, table_functions
from seqthin.operators import kmers, sketch, superkmers
from seqthin.plans import calibration
from seqthin.sources import fasta_source
from seqthin.streaming import memory

for _module in (kernels, kmers, sketch, superkmers, calibrate, fasta_source, table_functions, memory, calibration):
    cloudpickle.register_pickle_by_value(_module)

"""Probabilistic PCA of large, sparse and partly missing matrices on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .plans.em import PPCA, PPCAModel
from .plans.layout import RowLayout
from .plans.sketch import kth_singular_value, recon_error, residual_spectral_norm

# The few functions that run inside tasks travel with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "PPCA",
    "PPCAModel",
    "RowLayout",
    "kth_singular_value",
    "recon_error",
    "residual_spectral_norm",
]

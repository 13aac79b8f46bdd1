"""Spark-native field reconstruction: tall panels, spatial joins, graphs and estimators as DataFrame plans."""

import ctypes
import glob
import os

import numpy


def _one_blas_thread() -> None:
    """Keep numpy's matrix library to one thread in the driver and in Python workers.

    Tasks already fill the processors, matrices here are small, and the library's thread pool may not come back after a
    fork, such as that which starts the JVM.
    """
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # for processes started from here
    for path in glob.glob(os.path.join(os.path.dirname(numpy.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_one_blas_thread()

"""Analytics over collections of structures described by feature vectors, on PySpark DataFrames."""

import ctypes
import glob
import os


def _one_thread() -> None:
    """Matrix products and solvers with one thread in each process.

    An executor has as many tasks as cores. And a process that has forked since NumPy was loaded, as a driver does when it starts the
    JVM, can wait for ever in OpenBLAS's threads from some 100 rows on (seen with the OpenBLAS that NumPy 2.3 brings).
    """
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    import numpy

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(numpy.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


_one_thread()

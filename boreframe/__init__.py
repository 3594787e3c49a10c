"""boreframe: well-log quality and rock-type classification on Spark."""

import sys as _sys

# Python UDFs of this package (Arrow-batched formatter, KNN batches) are
# pickled by value, so executors need only numpy/pandas - not this package
# on their path (local workers and cluster executors alike).
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

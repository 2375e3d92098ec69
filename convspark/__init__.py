"""convspark: Spark-native data jobs for running and fine-tuning chat models.

Corpus preparation, prompt handling, frame-log replay, token scoring and
catalogue bookkeeping, each expressed as DataFrame / Spark SQL operators.
"""

__version__ = "0.1.0"


def _ship_by_value():
    """Executors need not have this package installed: Python functions of
    ours used inside tasks (pandas UDFs, grouped-state functions) are sent
    with the task by value."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - pyspark absent or already registered
        pass


_ship_by_value()

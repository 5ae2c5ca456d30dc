"""duelframe: PySpark operators for ordered entity logs and two-sided contests."""

__version__ = "0.1.0"

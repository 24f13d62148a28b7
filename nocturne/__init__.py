"""An analytics engine for long physiological recordings on Spark."""

__version__ = "0.2.0"

"""tablewright: exploring and cleaning large delimited-text tables on Spark."""

__version__ = "0.1.0"

"""bytegrams: frequent byte n-grams and sparse feature datasets as Spark jobs."""

__version__ = "0.1.0"

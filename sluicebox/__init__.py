"""sluicebox: a data-quality and dataset-preparation engine on PySpark DataFrames."""

__version__ = "0.1.0"

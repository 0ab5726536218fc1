"""utterlake: labelled short-text preparation, classification and answering on Spark DataFrames."""

__version__ = "0.1.0"

"""Page-scan and link analysis on Spark DataFrames."""

from pagescan.options import ScanOptions

__all__ = ["ScanOptions"]

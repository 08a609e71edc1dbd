"""tallyweave: automatic statistical screening of one flat table, written as Spark plans."""

__version__ = "0.1.0"

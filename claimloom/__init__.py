"""claimloom: claim analytics over document corpora as lazy Spark plans."""

__version__ = "0.1.0"

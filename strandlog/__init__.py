"""strandlog: versioned key/value data on Spark as a totally ordered mutation log and its derived views."""

__version__ = "0.1.0"

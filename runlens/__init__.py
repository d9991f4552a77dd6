"""runlens: analytics over language-model run events, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"

"""corvane: analytics over source-file corpora, expressed as Spark DataFrame programs."""

__version__ = "0.1.0"

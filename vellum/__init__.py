"""vellum: document-intelligence and corpus-preparation operators for Apache Spark."""

__version__ = "0.1.0"

"""lawloom: a Spark-first analytics engine for regulatory notices, their attachments and reports."""

__version__ = "0.1.0"

"""Text and conversation compression over whole tables, on Spark."""

__version__ = "0.1.0"

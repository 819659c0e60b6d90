"""tidemark: rating-stream, catch-log, clustering and timetable analytics as Spark plans."""

__version__ = "0.1.0"

"""tickpulse: stock-talk text analytics as Spark jobs."""

__version__ = "0.1.0"

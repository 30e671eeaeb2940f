"""candlewick: market-panel analytics (code x date) as Spark DataFrame programs."""

__version__ = "0.1.0"

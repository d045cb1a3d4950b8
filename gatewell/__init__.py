"""gatewell: build, check and guard table builds with plain Spark DataFrames."""

__version__ = "0.1.0"

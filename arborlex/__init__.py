"""A lexical code-graph and corpus analytics engine on the public Spark DataFrame API."""

__version__ = "0.1.0"

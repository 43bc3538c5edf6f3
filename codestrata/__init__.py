"""codestrata: source-corpus analytics as Spark DataFrame operators.

Files are rows; one distributed parse extracts nested entities; everything
after that is DataFrame work (joins, aggregates, windows) planned by Catalyst.
"""

__version__ = "0.1.0"

"""quarrymill: a Spark-native engine for document analytics and hybrid retrieval.

Every operator takes and returns DataFrames and leaves the physical plan to
Catalyst.  Python runs only where a rule is inherently sequential (markdown
blocks, greedy selection), and then in Arrow batches.
"""

__version__ = "0.1.0"

"""corvane: a PySpark-native engine for building, querying and measuring text corpora.

Everything relational is a DataFrame plan.  Python runs only where no built-in
expression can state the semantics, and then over Arrow batches.
"""

__version__ = "0.1.0"

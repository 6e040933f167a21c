"""keyloom: keyed, versioned data on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``streaming`` (Structured
Streaming adapters), ``plans`` (the registered queries).  The optional ``llm``
sub-package holds the text operators and is imported by nothing in here.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

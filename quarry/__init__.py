"""quarry: profile-driven extraction, cleaning, validation, analysis of variance
and document retrieval as Spark DataFrame operators.

Sub-packages: ``sources`` (readers, probes, sinks), ``operators`` (DataFrame in,
DataFrame out), ``functions`` (column expressions and exact selection helpers),
``plans`` (profile runner and the registered queries), ``streaming``
(Structured Streaming jobs).
"""

__version__ = "0.1.0"

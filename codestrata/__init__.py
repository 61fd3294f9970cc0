"""codestrata: source-intelligence analytics on PySpark.

A ``files`` DataFrame of source text goes in; typed relations (symbols, edges, field
references, risks, rules, forms, run histories) and a query library over them come out.
The optional subpackage :mod:`codestrata.llm` adds training-data operators; nothing outside
that subpackage imports it.
"""

__version__ = "0.1.0"

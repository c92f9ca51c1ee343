"""corpusloom: a PySpark engine for curating and querying text corpora.

Sub-packages
    sources     readers of declarative and archived corpora
    functions   column expressions and Arrow text kernels
    operators   relational operators (dedupe, classify, select, recall, review, publish ...)
    plans       registered queries and their SQL twins
    streaming   incremental runs
    llm         training-data operators (optional, nothing else imports it)
"""

__version__ = "0.1.0"

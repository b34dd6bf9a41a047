"""strandwise: Spark jobs for collections of DNA sequences (and, in ``llm``, training-data text)."""

__version__ = "0.1.0"

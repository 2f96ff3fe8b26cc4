"""lexora: ranked full-text retrieval as declarative Spark plans."""

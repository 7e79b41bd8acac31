"""Change-history analytics on Spark.

Tables of many hash-chained change histories ("chains") and many places they are
applied to ("targets") go in; verified links, divergences, pending work, replayed
state, compiled scripts and change events come out, all as DataFrames.
"""

from linkweave.session import local_session

__all__ = ["local_session"]

"""longform: plan, assemble and check long generated texts for many premises at once, as Spark jobs.

Every operator is a pure ``DataFrame -> DataFrame`` function keyed by ``story_id``; only the ledger,
the sinks and the stage runners perform actions or writes.
"""

__version__ = "0.1.0"

"""curio: active-learning text curation on Spark.

Clean and de-duplicate a document pool, group it into topic clusters with Spark ML,
then run a Thompson-sampling active-learning loop whose state lives in append-only
tables. Everything is a DataFrame expression; the driver only decides which jobs run.
"""

__all__ = ["session", "schemas"]

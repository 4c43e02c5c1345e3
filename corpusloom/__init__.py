"""Text-corpus analytics on Spark: declarative rules, deduplication, sampling, scoring and evaluation statistics."""

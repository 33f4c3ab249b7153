"""Traceable content at table scale: extraction, grounding, review, release, audit, as Spark DataFrame operators."""

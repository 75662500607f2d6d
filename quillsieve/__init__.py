"""Approximate set membership and corpus preparation on Spark."""

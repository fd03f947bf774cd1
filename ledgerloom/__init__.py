"""Reconciliation analytics on Spark: pairs, verdicts, scores, evidence and streams as DataFrame plans."""

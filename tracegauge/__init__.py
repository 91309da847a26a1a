"""Evaluation of generative-AI interactions, and corpus operators, as Spark DataFrame jobs."""

"""Tidewell: requirement-aware catalogue analytics on Spark."""

"""Vellum: document-layout analytics as declarative Spark plans."""

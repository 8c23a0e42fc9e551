"""Query language: parsing, classification, evidence, and compilation to Spark columns."""

"""Training-data operators on documents and pages. Nothing else in the package imports this."""

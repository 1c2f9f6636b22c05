"""inkwell: a PySpark engine for corpora of scanned, recognised and exported pages."""

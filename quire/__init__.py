"""A PySpark engine for layout-aware document text and bilingual corpora."""

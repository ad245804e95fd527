"""PySpark engine for radio-interferometric visibility data."""

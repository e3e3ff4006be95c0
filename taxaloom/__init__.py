"""taxaloom: a PySpark engine for screening candidate species against a region's climate."""

"""A PySpark engine for dense 3-D imaging data, as lazy DataFrame operators."""

"""recallspark: a PySpark engine for long conversation memories.

Every operator takes and returns DataFrames; nothing is collected to the
driver except results whose size is bounded by a stated parameter.
"""

__version__ = "0.1.0"

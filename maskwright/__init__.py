"""maskwright: word-level redaction labelling, perturbation and evaluation on Spark.

Every operator takes and returns DataFrames (or Columns); nothing here runs a job
unless its docstring says so.
"""

__version__ = "0.1.0"

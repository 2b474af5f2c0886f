"""souba: price intelligence for second-hand marketplace listings on PySpark.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing here triggers a job unless it writes or fits a model.
"""

"""Spark-native analytics for image collections, scan histories and classifier
evaluation.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; unless its docstring says otherwise it triggers no Spark action.
"""

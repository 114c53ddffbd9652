"""Document analytics on Spark: every public function takes and returns DataFrames or Columns."""

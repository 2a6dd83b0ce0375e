"""Register analytics for extracted correspondence, written as Spark DataFrame operators."""

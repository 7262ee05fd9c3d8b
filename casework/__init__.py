"""casework: case evaluation and corpus profiling as Spark DataFrame operators."""

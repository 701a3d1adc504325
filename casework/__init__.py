"""casework: Spark jobs for large-scale casework over text."""

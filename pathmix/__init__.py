"""pathmix: sequence analytics over node paths, expressed as Spark DataFrames."""

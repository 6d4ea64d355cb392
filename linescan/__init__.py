"""linescan: line search over large text corpora, expressed as Spark DataFrames."""

"""sparkferry: table synchronisation and corpus operators on Spark DataFrames."""

"""symloom: analytics over large corpora of disassembled application code, on Spark DataFrames."""

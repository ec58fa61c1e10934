"""casefuse: consolidate records reported by several unreliable sources, as Spark DataFrames."""

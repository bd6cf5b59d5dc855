"""Reading tickets and writing results."""

"""rollmill: analytics on agent trajectories, and on the data sets made of them, with Spark."""

"""Decision analytics over operational logs and experiment runs, as Spark jobs.

Every public function takes DataFrames and returns DataFrames. Nothing is collected
to the driver; the only eager step is a bounded size check before a broadcast.
"""

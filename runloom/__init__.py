"""runloom: Spark jobs over the tables an ML workflow keeps.

Train, compare, gate, register and score models; fold task attempts to states;
answer questions on runs, schedules, revisions, versions and metrics; walk
dependency graphs.  Everything is DataFrame, MLlib or Structured Streaming code.
"""

"""Analytics for animal-borne data loggers, written as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame.  Nothing is
evaluated until the caller writes or counts the result; the few places that
must run a job earlier (a loop until stable, a measured slice width) say so.
"""

"""voxcart: customer-feedback and marketing analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a lazy DataFrame (or a streaming
writer), so Catalyst plans whole jobs end to end and AQE adapts them at run
time.  Models are user-supplied callables.
"""

__version__ = "0.1.0"

"""webtraffic: web-traffic analytics on Spark DataFrames.

Hits (batch or stream) are folded into visitors, sessions, page views and visitor details by
aggregation; reports are plain DataFrame functions over those tables with an explicit
reference time ``as_of``.
"""

__version__ = "0.1.0"

"""quarry: a Spark-native analytics engine.

Every operator takes and returns DataFrames, so Catalyst sees one declarative
plan per query.  Sub-packages:

* ``sources``    scans and sinks
* ``functions``  column-level functions (pure expressions)
* ``operators``  relational, mining, graph and recommender operators
* ``plans``      named queries over the test tables
* ``streaming``  Structured Streaming counterparts of the sketches
"""

__version__ = "0.1.0"

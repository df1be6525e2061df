"""ashgrid: wildfire and air-quality analytics as Spark DataFrame operators.

Sub-packages:
  functions  column expressions (unit conversions, formulas, projections, statistics)
  sources    readers and the derived fixture views
  operators  table operators: joins, aggregates, sequences, pixel tables, evaluation, quality
  plans      end-to-end jobs and the registered queries with their SQL oracles
  streaming  the sensor annotation job as a Structured Streaming query
"""

__version__ = "0.1.0"

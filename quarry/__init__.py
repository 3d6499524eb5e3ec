"""quarry: Spark-native sensor analytics and static script inventory.

Two families of operators on ordinary DataFrames:

* the sensor job (``quarry.plans.sensor``): declared-schema scans, a native
  math transform, a null filter, two left joins, a per-location rank, a
  grouped aggregate, table sinks and a run report;
* the script inventory (``quarry.plans.calls``): a table of program sources
  is parsed once per script on the executors, and every later step (target
  matching, argument and caller resolution, reachability, de-duplication,
  I/O inventory) is DataFrame work.

Nothing in a script is ever executed.
"""

__version__ = "0.1.0"

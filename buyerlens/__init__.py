"""buyerlens: buyer feature building, scoring and uplift evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function that keeps the buyer
key as an ordinary column, so results do not depend on partitioning or row
order.  Subpackages:

* ``sources``   - table readers, fixture views over the driver tables, file sinks
* ``functions`` - scalar Column builders (dates, value maps, key hashing)
* ``operators`` - cleaning, aggregation, windows, encoding, splits, models,
                  metrics, composite scoring, uplift
* ``plans``     - end-to-end dataflows and the registered query catalog
* ``streaming`` - file-stream variant of the batch scoring job
"""

__version__ = "0.1.0"

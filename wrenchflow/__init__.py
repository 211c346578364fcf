"""wrenchflow: service-shop analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrames (plus typed parameters) and returns a
DataFrame without triggering an action; the physical plan is left to
Catalyst/AQE.  Sub-packages:

* ``sources``   -- table loading, schema conformance, fixture binding, sinks
* ``functions`` -- column expressions, predicates and date helpers
* ``operators`` -- joins, metrics, interval logic, nested documents,
                   data-quality rules and batch state changes
* ``plans``     -- the catalogue of registered queries with SQL oracles
* ``streaming`` -- the activity-log feed (Structured Streaming)
"""

from wrenchflow.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

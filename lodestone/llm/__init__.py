"""Training-data operators: deduplication, extraction, tokenising, classifiers, sharding.

The subpackage stands alone: nothing else in the library imports it.  Executors
import it by name, so ship the repository with ``--py-files`` on a cluster.
"""

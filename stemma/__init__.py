"""stemma: a PySpark-native analytics engine for software-supply-chain provenance.

A stemma is the family tree of a set of manuscripts.  Here the manuscripts are
build artifacts: every artifact has a content-derived identifier, every build
step links one output to its inputs, and the engine answers questions over the
resulting Merkle graph with DataFrame and SQL plans.
"""

__version__ = "0.1.0"

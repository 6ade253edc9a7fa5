"""diffloom: code-change corpora as Spark jobs.

Extract line and token edits from (old, new) pairs, expand them into
intermediate states, assemble training sets, build masked and corrupted
examples with key-derived randomness, and score predictions with corpus
metrics.  Everything is ``DataFrame -> DataFrame``.
"""

__version__ = "0.1.0"

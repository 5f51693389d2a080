"""Training-data operators.

Thirteen operators for corpus preparation, each a function from DataFrames plus
parameters to a DataFrame (see each module's docstring for the defined
result on nulls, empty texts, repeated rows and clashing column names):

``minhash`` (document fingerprints), ``token_counts``, ``line_dedup``,
``url_filter``, ``sharding``, ``mixing``, ``jaccard_join``, ``language_id``,
``decontaminate``, ``quote_links``, ``collocations``, ``merkle`` (dataset
manifests) and ``token_files``.  Shared parts: ``words`` (splitting and
hashing), ``simple8b`` (packed words), ``workers`` (state of a worker), ``grouped`` (exact resolution of candidate groups),
``components``, ``ranks`` (distributed row numbers) and ``storage``
(checkpoints in the shared folder).
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so the
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

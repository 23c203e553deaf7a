"""relsift: search-relevance text analytics as Spark DataFrame operators.

Subpackages
-----------
sources    driver tables, the ``rel`` fixture, CSV / text sources and sinks
functions  row-local column expressions (cleaning, tokens, pair features)
operators  DataFrame -> DataFrame operators (features, corpus, TF-IDF, naive
           Bayes, vectors, models, evaluation, augmentation, skew helpers)
plans      end-to-end flows and the query registry used by ``__spark_entry__``
streaming  Structured Streaming form of the row-local feature operators
"""

__version__ = "0.1.0"

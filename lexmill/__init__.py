"""lexmill: language-model corpus preparation expressed as Spark jobs.

Text cleaning, subword vocabularies, token sequences, seeded splits and shards,
and evaluation reports.  Every public operator takes and returns a DataFrame;
row-local pieces are also available as ``Column -> Column`` functions under
``lexmill.functions``.
"""

__version__ = "0.1.0"

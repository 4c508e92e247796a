"""codecorpus: Spark-native preparation and evaluation of code-function corpora.

Subpackages: ``functions`` (Column -> Column text/array functions),
``operators`` (DataFrame -> DataFrame joins, metrics, ordering, packing),
``sources`` (readers and writers), ``plans`` (registered queries and their
SQL twins), ``streaming`` (incremental evaluation).
"""

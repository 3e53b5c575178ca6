"""tokenloom: semantic-ID analytics expressed as Spark DataFrame plans.

Layers:
  sources/    scans and sinks (tag TSV, JSON feature documents, Parquet/CSV tables)
  functions/  column expressions (tag parsing, JSON leaves, feature catalog, IDs)
  operators/  DataFrame -> DataFrame operators (tags, linear algebra, RVQ,
              dictionary coding, neighbors, quality, training sets, ANOVA)
  plans/      multi-step plans (grid searches, end-to-end programs, query registry)
  streaming/  stateless model application on streaming DataFrames
"""

__version__ = "0.1.0"

"""newsloom: content-aggregation analytics as Spark DataFrame operators."""

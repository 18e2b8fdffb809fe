"""Rules and predicates compiled to Spark columns, and the registered queries."""

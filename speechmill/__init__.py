"""Meeting-transcript analytics expressed as Spark DataFrame operators."""

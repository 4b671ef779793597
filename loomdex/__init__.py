"""Text search, link analytics and corpus preparation as Spark DataFrame operators."""

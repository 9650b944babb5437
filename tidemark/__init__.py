"""tidemark: community analytics and training-data preparation on PySpark."""

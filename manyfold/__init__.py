"""Multi-model analytics and training-corpus preparation on PySpark."""

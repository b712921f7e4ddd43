"""newsweave: news-intelligence data pipelines as PySpark DataFrame operators."""

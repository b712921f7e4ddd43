"""DataFrame operators of the news pipelines."""

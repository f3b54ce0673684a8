"""Registry of runnable queries: name -> f(spark, sf_dir)."""

QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register

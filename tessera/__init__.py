"""tessera: instance analytics and corpus engineering on Spark."""

"""memlake: a PySpark-native memory, retrieval and corpus analytics library."""

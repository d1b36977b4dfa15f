"""tessera: corpus retrieval, masking, synchronisation and analytics on PySpark."""

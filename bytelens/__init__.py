"""bytelens: byte-stream, record and measurement analytics expressed as Spark plans."""

"""orbweave: spatial, vector, mask and graph analytics expressed as Spark DataFrame plans."""

"""Street-network and low-traffic block analytics on Spark."""

"""trafficlens: cache-traffic analytics and policy replay as Spark DataFrame operators."""

"""barloom: candle analytics as Spark plans."""

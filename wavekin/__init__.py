"""wavekin: similarity search and analytics over data series, as Spark DataFrame plans."""

"""vortiq: Spark-native analytics for sequences of planar velocity fields and for text corpora."""

"""Court analytics on Spark: detections in, positions, rallies, stats and datasets out."""

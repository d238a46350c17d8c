"""Timeline analytics on Spark: timed segments, frames, embeddings and model outputs."""

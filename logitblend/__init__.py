"""Top-k-union blending of logged model logits, and benchmark scoring, as Spark jobs."""
